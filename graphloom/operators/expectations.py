"""What was expected against what was found: repeated rows match one to one, folders stand for anything below them, scores are weighted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.tables import Rounds

_KEYS = ["case", "code"]


def matched(expected: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((case, code, subject, expected, met, missed), (case, code, found, extra)) of rows (case, code, subject), each as often as it stands there.

    An expected subject is a path, or a folder with ``/*`` for any path below it (``*`` for any at all); it takes found rows one to one, and as many are met as can
    be. Whole paths take theirs first, then folders from the deepest up: what these can take lies within what those above can, so no other order meets
    more. Only counts of paths and folders move, a level at a time, never pairs. Null subjects are the path ``''``; of found rows that a folder takes, none is named.
    """
    rounds = Rounds(expected.sparkSession)
    plain = lambda rows: rows.select(F.coalesce("case", F.lit("")).alias("case"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("subject", F.lit("")).alias("subject"))
    asked = rounds.table(plain(expected).groupBy(*_KEYS, "subject").agg(F.count("*").alias("expected")))
    there = plain(found).groupBy(*_KEYS, "subject").agg(F.count("*").alias("found"))
    folder = F.when(F.col("subject") == "*", F.lit("")).when(F.col("subject").endswith("/*"), F.expr("left(subject, length(subject) - 2)"))
    exact = asked.where(folder.isNull())
    both = there.join(exact, [*_KEYS, "subject"], "full_outer").select(*_KEYS, "subject", F.coalesce("found", F.lit(0)).alias("found"), "expected")
    both = rounds.table(both.withColumn("met", F.least("found", F.coalesce("expected", F.lit(0)))))
    # Folders as ``/a/b``, the repository as ``''``: a path's parent is what stands before its last slash, so all lie on one ladder.
    above = lambda path: F.expr(f"left({path}, length({path}) - length(substring_index({path}, '/', -1)) - 1)")
    rows = both.where("found > met").select(*_KEYS, F.concat(F.lit("/"), "subject").alias("path"), F.col("found") - F.col("met"))
    left = rows.toDF(*_KEYS, "path", "left").select(*_KEYS, above("path").alias("folder"), "left")
    wanted = asked.select("*", F.when(folder == "", F.lit("")).otherwise(F.concat(F.lit("/"), folder)).alias("folder")).where(folder.isNotNull())
    depth = F.size(F.split("folder", "/")) - 1
    ladder = left.select(*_KEYS, "folder", "left", F.lit(0).cast("long").alias("expected"), F.lit(None).cast("string").alias("subject"))
    ladder = ladder.unionByName(wanted.select(*_KEYS, "folder", F.lit(0).cast("long").alias("left"), "expected", "subject"))
    sums = [F.sum("left").alias("left"), F.sum("expected").alias("expected"), F.max("subject").alias("subject")]
    own = rounds.table(ladder.groupBy(*_KEYS, "folder").agg(*sums).withColumn("depth", depth))
    deepest = own.agg(F.max("depth")).first()[0]
    level, taken = None, [both.where("expected is not null").select(*_KEYS, "subject", "expected", "met")]
    for at in range(-1 if deepest is None else deepest, -1, -1):
        here = own.where(F.col("depth") == at).drop("depth")
        if level is not None:
            carried = level.where("left > met").select(*_KEYS, above("folder").alias("folder"), (F.col("left") - F.col("met")).alias("left"), F.lit(0).cast("long").alias("expected"), F.lit(None).cast("string").alias("subject"))
            here = here.unionByName(carried)
        level = rounds.table(here.groupBy(*_KEYS, "folder").agg(*sums).withColumn("met", F.least("left", "expected")))
        taken.append(level.where("subject is not null").select(*_KEYS, "subject", "expected", "met"))
    met = rounds.table(reduce(DataFrame.unionByName, taken))
    per_code = both.groupBy(*_KEYS).agg(F.sum("found").alias("found"))
    extras = per_code.join(met.groupBy(*_KEYS).agg(F.sum("met").alias("met")), _KEYS, "left").select(*_KEYS, "found", (F.col("found") - F.coalesce("met", F.lit(0))).alias("extra")).where("found > 0")
    return met.withColumn("missed", F.col("expected") - F.col("met")), extras


def weighted_score(*parts: tuple[Column, float]) -> Column:
    """Hundredths of shares (0 to 1) by their weights, held within 0 and 100; a share that is null counts as 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(share, F.lit(0.0)) * F.lit(float(weight)) for share, weight in parts])
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100))


def case_scores(met: DataFrame, extras: DataFrame, *, recall: float = 0.7, precision: float = 0.3) -> DataFrame:
    """(case, expected, met, missed, extra, score) from what ``matched`` returns; a case that expects and finds nothing scores 100."""
    a = met.groupBy("case").agg(F.sum("expected").alias("expected"), F.sum("met").alias("met"))
    b = extras.groupBy("case").agg(F.sum("extra").alias("extra"))
    n = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    rows = a.join(b, "case", "full_outer").select("case", n("expected"), n("met"), n("extra"))
    share = lambda whole: F.when(whole > 0, F.col("met") / whole).otherwise(F.lit(1.0))
    score = weighted_score((share(F.col("expected")), recall), (share(F.col("met") + F.col("extra")), precision))
    return rows.select("case", "expected", "met", (F.col("expected") - F.col("met")).alias("missed"), "extra", F.round(score, 4).alias("score"))


def stale_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(family, name, level, passed, stale) of every result (family, name, passed) that a claim (family, name, level) speaks of.

    A claim of the same name counts first, else the least one of a name that differs only in case, and in dots or blanks for dashes. Stale is a ``supported`` claim
    whose case fails, and any other whose case passes.
    """
    normal = lambda name: F.lower(F.translate(name, ". ", "--"))
    key = F.coalesce("family", F.lit(""))
    said = claims.select(key.alias("__f"), normal(F.col("name")).alias("__k"), F.col("name").alias("__name"), "level")
    one = said.groupBy("__f", "__k").agg(F.min(F.struct("__name", "level")).alias("any"))
    same = said.groupBy(F.col("__f").alias("__sf"), "__name").agg(F.min("level").alias("same"))
    rows = results.select("family", "name", "passed", key.alias("__rf"), normal(F.col("name")).alias("__rk"))
    out = rows.join(one, (F.col("__rf") == F.col("__f")) & (F.col("__rk") == F.col("__k"))).join(same, (F.col("__rf") == F.col("__sf")) & (F.col("name") == F.col("__name")), "left")
    level = F.coalesce("same", F.col("any.level"))
    return out.select("family", "name", level.alias("level"), "passed", F.when(level == "supported", ~F.col("passed")).otherwise(F.col("passed")).alias("stale"))
