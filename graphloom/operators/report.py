"""What happens to findings after the analyzers: baselines, scopes, focus, counts, trust, reviews, deletions, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import lowered, subject_path
from graphloom.functions.globs import any_glob

RANK = {"high": 0, "medium": 1, "low": 2}


def new_findings(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return found.join(baseline.select(F.col("id").alias("__b")).distinct(), F.col("id") == F.col("__b"), "left_anti")


def in_scope(found: DataFrame, paths: DataFrame, *, complete: bool = True) -> DataFrame:
    """Findings whose subject names a path of the scope; all, if the scope is incomplete."""
    if not complete:
        return found
    tokens = found.select("id", F.explode(F.split("subject", " -> ")).alias("t")).select("id", subject_path(F.col("t")).alias("t"))
    hit = tokens.join(paths.select(F.col("path").alias("__p")).distinct(), F.col("t") == F.col("__p"), "left_semi").select(F.col("id").alias("__i")).distinct()
    return found.join(hit, F.col("id") == F.col("__i"), "left_semi")


def focused(found: DataFrame, globs: list[str]) -> DataFrame:
    """Findings of which a part of the subject fits a glob. For after the analyses: below them it would change answers."""
    regex = any_glob(globs)
    return found.where(F.exists(F.split("subject", " -> "), lambda t: subject_path(t).rlike(regex)))


def suppressed(found: DataFrame, ignores: list[tuple[str, list[str]]]) -> DataFrame:
    """Findings less those of an ignored code in an ignored file."""
    hit = F.lit(False)
    for code, globs in ignores:
        hit |= (F.col("code") == code) & subject_path(F.col("subject")).rlike(any_glob(globs))
    return found.where(~hit)


def counts(found: DataFrame) -> DataFrame:
    one = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return found.agg(F.count("*").alias("total"), one("severity", "error"), one("severity", "warn"), one("severity", "info"), one("confidence", "high"), one("confidence", "medium"), one("confidence", "low"))


def top(found: DataFrame, n: int, severities: list[str]) -> DataFrame:
    return found.where(F.col("severity").isin(*severities)).orderBy("id").limit(n)


def downgraded(found: DataFrame, globs: list[str] | None) -> DataFrame:
    """Confidence one level lower where a trust signal applies: in the paths given, or everywhere for None."""
    hit = F.lit(True) if globs is None else subject_path(F.col("subject")).rlike(any_glob(globs))
    return found.withColumn("confidence", F.when(hit, lowered(F.col("confidence"))).otherwise(F.col("confidence")))


def reviewed(found: DataFrame, *, strict_trust: bool = False) -> DataFrame:
    """``found`` with ``decision``: blocking if sure and no mere information, else advisory; with strict trust all are advisory."""
    blocks = (F.col("confidence") == "high") & F.col("severity").isin("error", "warn") & F.lit(not strict_trust)
    return found.withColumn("decision", F.when(blocks, "blocking").otherwise("advisory"))


def safe_delete(targets: DataFrame, flagged: DataFrame, dependents: DataFrame, pressure_pct: int) -> DataFrame:
    """targets: path. flagged: subject, confidence. dependents: path with files outside the targets that need it. Returns (path, verdict)."""
    conf = flagged.groupBy(F.col("subject").alias("__s")).agg(F.bool_or(F.col("confidence") == "low").alias("any_low"), F.bool_and(F.col("confidence") == "high").alias("all_high"))
    rows = targets.join(conf, F.col("path") == F.col("__s"), "left").join(dependents.select(F.col("path").alias("__d")).distinct(), F.col("path") == F.col("__d"), "left")
    verdict = F.when(F.col("__s").isNull(), "blocked").when(F.col("__d").isNotNull(), "blocked").when(F.lit(pressure_pct > 5), "needs-review").when(F.col("any_low"), "needs-review").when(F.col("all_high"), "safe").otherwise("needs-review")
    return rows.select("path", verdict.alias("verdict"))


def deletion_order(safe: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, position) by the edges into each from the safe set, then by path. safe: file_id, path."""
    inside = edges.join(safe.select(F.col("file_id").alias("__s")), F.col("src") == F.col("__s"), "left_semi")
    degree = inside.groupBy(F.col("dst").alias("__d")).agg(F.count("*").alias("indegree"))
    rows = safe.join(degree, F.col("file_id") == F.col("__d"), "left").select("path", F.coalesce("indegree", F.lit(0)).alias("indegree"))
    return rows.withColumn("position", F.row_number().over(Window.orderBy("indegree", "path")))  # a report: what one person deletes


def recovered(deleted: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleted paths (path) that the last path index (path, file_id) still knows, with their ids, and those that it doesn't."""
    known = index.select(F.col("path").alias("__p"), "file_id").distinct()
    return deleted.join(known, F.col("path") == F.col("__p")).drop("__p"), deleted.join(known, F.col("path") == F.col("__p"), "left_anti")


def break_edges(chains: DataFrame) -> DataFrame:
    """(component, position, src, dst): the steps of each cycle's chain, where it can be broken."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("chain") - 2), lambda k: F.struct(F.get("chain", k).alias("src"), F.get("chain", k + 1).alias("dst")))
    return chains.where(F.size("chain") > 1).select("component", F.posexplode(pairs).alias("position", "__e")).select("component", "position", "__e.src", "__e.dst")


def advice(found: DataFrame) -> DataFrame:
    """(code, findings, blocking, text): what a review says of each kind of finding, most blocking ones first."""
    rows = reviewed(found).groupBy("code").agg(F.count("*").alias("findings"), F.count_if(F.col("decision") == "blocking").alias("blocking"), F.min(F.struct("id", "subject"))["subject"].alias("first"))
    text = F.when(F.col("blocking") > 0, F.format_string("Settle %d of %d %s findings before merging, for instance `%s`.", "blocking", "findings", "code", "first")).otherwise(F.format_string("Look at %d %s findings, for instance `%s`.", "findings", "code", "first"))
    return rows.select("code", "findings", "blocking", text.alias("text")).orderBy(F.col("blocking").desc(), "code")


def ranked_actions(found: DataFrame) -> DataFrame:
    """One action per finding, in order of phase, confidence and id, with its rank inside its phase."""
    phase = F.when(F.col("code").isin("unused-file", "unused-package"), 1).when(F.col("code").startswith("unused"), 2).otherwise(3)
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return found.select("id", phase.alias("phase"), order.alias("risk")).withColumn("rank", F.row_number().over(Window.partitionBy("phase").orderBy("risk", "id")))


def phases(actions: DataFrame) -> DataFrame:
    """Per phase: actions, the worst risk, and the best confidence."""
    return actions.groupBy("phase").agg(F.count("*").alias("actions"), F.max("risk").alias("risk"), F.min("risk").alias("best"))


def sarif(found: DataFrame) -> DataFrame:
    """One JSON result per finding."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warn", "warning").otherwise("note")
    return found.select("id", F.to_json(F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("subject").alias("text")).alias("message"))).alias("result"))
