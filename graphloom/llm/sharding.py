"""Sharding: a uniform shuffle with exact shard sizes through a hypergeometric communication matrix.

1. The rows are written once with their partition and their place in it, so every later read sees the same partitions.
2. The driver gets one count per partition and draws how many rows each partition sends to each shard: row by row a multivariate
   hypergeometric draw from what the shards still need, one shard after the other, for counts of any size. Column sums are the shard sizes, equal to within one row.
3. Every partition is permuted by itself and cut by its row of the matrix; that is the exchange.
4. Each shard is permuted again: rows fall into cells at random, cells are permuted by themselves, and cell counts give the offsets.

The driver holds a count per partition and per cell, never rows; no task holds more than a partition or a cell.

Defined cases: a null text has size 1 and the checksum of an empty one; null and repeated ids are rows like others; an empty table
gives an empty result; texts of any length go along. Input columns named ``shard`` or ``slot`` are replaced, all others go along (internal
names are chosen so that they clash with none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Workspace, unused_name

CELL_ROWS = 500_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn from ``good`` and ``bad`` ones are good, for numbers of any size (numpy's own draw ends at 10^9).

    Give every item a uniform number and look below t = n / (good + bad): the good and bad ones there are binomial, and what is missing
    from ``n`` is a draw from the items above t, or what is too many a draw from those below. Each step leaves about the square root of
    the draw before, until few are left to be drawn one by one. This is the exact law, whatever t is.
    """
    found, sign = 0, 1
    while n > 24:
        if 2 * n > good + bad:  # draw those that stay instead
            found, sign, n = found + sign * good, -sign, good + bad - n
            continue
        t = n / (good + bad)
        g, b = int(rng.binomial(good, t)), int(rng.binomial(bad, t))
        found += sign * g
        if g + b <= n:
            good, bad, n = good - g, bad - b, n - g - b
        else:
            good, bad, n, sign = g, b, g + b - n, -sign
    for _ in range(n):
        hit = int(rng.integers(good + bad)) < good
        found += sign * hit
        good, bad = good - hit, bad - (not hit)
    return found


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows each partition sends to each shard: exact margins, every assignment equally likely."""
    total = sum(counts)
    need = np.full(shards, total // shards, np.int64)
    need[: total % shards] += 1
    rng = np.random.default_rng(seed)
    rng.shuffle(need)
    out = np.zeros((len(counts), shards), np.int64)
    left = total
    for i, n in enumerate(counts):
        others, rest = left, n
        for s in range(shards):
            others -= int(need[s])
            out[i, s] = hypergeometric(rng, int(need[s]), others, rest)
            rest -= int(out[i, s])
        need -= out[i]
        left -= n
    return out


def shuffled_shards(rows: DataFrame, shards: int, *, seed: int = 17, space: Workspace | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    spark = rows.sparkSession
    space = space or Workspace(spark, "shards")
    rows = rows.drop("shard", "slot")
    kept = rows.columns
    row, part, upto_, at, cell, start = (unused_name(rows, n) for n in ("row", "part", "upto", "at", "cell", "start"))
    # A row's id holds its partition above bit 33 and its place below.
    placed = space.table(rows.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, 33).cast("int")), "rows")
    counts = sorted((r[part], r["n"]) for r in placed.groupBy(part).agg(F.count("*").alias("n")).collect())
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    upto = np.cumsum(matrix, axis=1)
    schema = T.StructType([T.StructField(part, T.IntegerType()), T.StructField(upto_, T.ArrayType(T.LongType()))])
    sends = spark.createDataFrame([(p, upto[i].tolist()) for i, (p, _) in enumerate(counts)], schema)

    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), part, row), row)
    dealt = placed.withColumn(at, F.row_number().over(local) - 1).join(sends, part)
    dealt = dealt.withColumn("shard", F.size(F.filter(upto_, lambda u: u <= F.col(at))))

    total = sum(n for _, n in counts)
    cells = max(1, -(-total // (shards * CELL_ROWS)), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    dealt = dealt.withColumn(cell, F.pmod(F.xxhash64(F.lit(seed + 1), row), F.lit(cells)).cast("int"))
    dealt = space.table(dealt.select(*kept, "shard", row, cell), "dealt")
    sizes = {(r["shard"], r[cell]): r["n"] for r in dealt.groupBy("shard", cell).agg(F.count("*").alias("n")).collect()}
    starts = []
    for s in range(shards):
        upto_here = 0
        for c in range(cells):
            starts.append((s, c, upto_here))
            upto_here += sizes.get((s, c), 0)
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField(cell, T.IntegerType()), T.StructField(start, T.LongType())])
    offsets = spark.createDataFrame(starts, schema)
    again = Window.partitionBy("shard", cell).orderBy(F.xxhash64(F.lit(seed + 2), row), row)
    out = dealt.withColumn(at, F.row_number().over(again) - 1).join(offsets, ["shard", cell])
    return out.select(*kept, "shard", (F.col(start) + F.col(at)).cast("long").alias("slot"))
