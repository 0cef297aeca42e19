"""Generations of a stream of changes against a debounce by hand."""

import datetime as dt
import random

from pyspark.sql import functions as F

from graphloom.operators.tables import Rounds
from graphloom.streaming.debounce import rebuild_when_quiet

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def by_hand(changes, quiet, until):
    """Bursts (root, generation, started, ended, paths) that have ended ``until`` then."""
    out = []
    for root in {c[0] for c in changes}:
        bursts = []
        for _, path, at in sorted((c for c in changes if c[0] == root), key=lambda c: c[2]):
            if bursts and at - bursts[-1][1] < quiet:
                bursts[-1][1] = at
                bursts[-1][2].add(path)
            else:
                bursts.append([at, at, {path}])
        out += [(root, k, a, b, tuple(sorted(paths))) for k, (a, b, paths) in enumerate(bursts, 1) if b + quiet <= until]
    return sorted(out)


def test_generations(spark):
    rng = random.Random(6)
    root = Rounds(spark).root
    changes, at = [], 0
    for _ in range(150):  # microseconds; gaps around the quiet time of a second
        at += rng.choice([0, 150_000, 900_000, 999_999, 1_000_000, 2_500_000])
        changes.append((rng.choice("ab"), rng.choice(["src/x.ts", "src/y.ts", "package.json", "logo.png"]), at))
    sent = sorted(changes, key=lambda c: c[2] + rng.randrange(8_000_000))  # up to eight seconds out of order
    sent += rng.sample(sent[-20:], 5)  # and some again
    schema = "root string, path string, ts timestamp"
    for k in range(0, len(sent), 40):
        rows = [(r, p, START + dt.timedelta(microseconds=m)) for r, p, m in sent[k : k + 40]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    run = lambda: rebuild_when_quiet(source(), write, f"{root}/checkpoint", quiet_ms=1000, late="10 seconds").awaitTermination()
    run()
    zero = int(START.timestamp()) * 1_000_000
    got = lambda: sorted((r[0], r[1], r[2] - zero, r[3] - zero, tuple(r[4])) for r in spark.read.parquet(f"{root}/out").groupBy("root", "generation", "started", "ended").agg(F.array_sort(F.collect_list("path"))).collect())
    relevant = [c for c in changes if c[1] != "logo.png"]
    want = by_hand(relevant, 1_000_000, max(c[2] for c in relevant) - 10_000_000)
    assert got() == want and len(want) > 20
    # A later run goes on with what was open; what comes too late is no change.
    more = [("a", "late.ts", 5), ("b", "src/z.ts", at + 60_000_000)]
    spark.createDataFrame([(r, p, START + dt.timedelta(microseconds=m)) for r, p, m in more], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    run()
    assert got() == by_hand([*relevant, more[1]], 1_000_000, at + 50_000_000)
