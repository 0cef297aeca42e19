"""Analyzers: canonical tables to findings. Thresholds are those of the reference semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import dead_code_candidate, finding_id, looks_like_package
from graphloom.operators.fixes import ACTIONS
from graphloom.operators.tables import shuffled

#: What settles a finding, by code; of other codes nothing is known to.
REMEDIES = {code: action for codes, action, *_ in ACTIONS for code in codes}


#: What a finding is about, by the first words of its code; others are their own category.
CATEGORIES = {"ownership": "ownership-violation", "boundary": "boundary-violation", "cycle": "cycle", "unlisted": "unlisted-dependency"}


def findings(rows: DataFrame, code: Column | str, subject: Column, confidence: Column | str, *, rule: Column | None = None, severity: str = "warn", evidence: Column | None = None) -> DataFrame:
    """Rows (id, code, severity, confidence, subject, rule_name), and ``evidence`` if it is given."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    rule = F.lit(None).cast("string") if rule is None else rule
    return rows.select(finding_id(lit(code), subject, F.coalesce(rule, F.lit(""))).alias("id"), lit(code).alias("code"), F.lit(severity).alias("severity"), lit(confidence).alias("confidence"), subject.alias("subject"), rule.alias("rule_name"), *([evidence.alias("evidence")] if evidence is not None else []))


def with_remedy(found: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in REMEDIES.items() for x in pair])
    return found.withColumn("remedy", F.try_element_at(table, F.col("code")))


def file_confidence(effective: Column, pct: Column, neighbour: Column, no_incoming: Column) -> Column:
    low = (effective >= 5) | (pct > 15) | (neighbour >= 8)
    sure = no_incoming & (effective == 0)
    return F.when(low, "low").when(sure & ((pct > 5) | (neighbour >= 3)), "medium").when(sure, "high").otherwise("medium")


def unused_files(files: DataFrame, reached: DataFrame, edges: DataFrame, pressure: DataFrame, *, production: bool = False) -> DataFrame:
    """Candidates that no entry reaches. files: file_id, rel_path, role, directory. pressure: file_id, unresolved, resolved."""
    total = pressure.agg(F.sum("unresolved").alias("u"), F.sum("resolved").alias("r")).select(F.coalesce(F.floor(F.col("u") * 100 / F.when(F.col("u") + F.col("r") > 0, F.col("u") + F.col("r"))), F.lit(0)).cast("long").alias("pct"))
    base = files.join(shuffled(pressure.select(F.col("file_id").alias("__p"), F.col("unresolved").alias("own"))), F.col("file_id") == F.col("__p"), "left").withColumn("own", F.coalesce("own", F.lit(0)))
    near = base.groupBy(F.col("directory").alias("__d")).agg(F.sum("own").alias("dir_total"))
    base = base.join(shuffled(near), F.col("directory") == F.col("__d")).withColumn("neighbour", F.greatest(F.col("dir_total") - F.col("own"), F.lit(0)))
    entered = edges.where("src <> dst").select(F.col("dst").alias("__in")).distinct()
    dead = base.where(dead_code_candidate(F.col("role"), F.col("rel_path"), production=production)).join(shuffled(reached.select(F.col("node").alias("__n")).distinct()), F.col("file_id") == F.col("__n"), "left_anti")
    dead = dead.join(shuffled(entered), F.col("file_id") == F.col("__in"), "left").crossJoin(F.broadcast(total))  # one row
    return findings(dead, "unused-file", F.col("rel_path"), file_confidence(F.col("own"), F.col("pct"), F.col("neighbour"), F.col("__in").isNull()))


def export_confidence(is_type: Column, effective: Column, pct: Column, neighbour: Column, globbed: Column, wanted: Column) -> Column:
    alone = (effective == 0) & (neighbour == 0) & ~wanted
    low = is_type | (effective >= 5) | (pct > 15) | (neighbour >= 8)
    return F.when(low, "low").when(globbed, "medium").when(alone & (pct <= 5), "high").otherwise("medium")


def dependency_confidence(effective: Column, only_scripts: Column, dep_kind: Column) -> Column:
    low = (effective > 8) | only_scripts | ((effective > 3) & (dep_kind == "peer dependency"))
    return F.when(low, "low").otherwise("medium")


def unused_dependencies(declared: DataFrame, used: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Declared (workspace, dep, dep_kind) without a use in the workspace."""
    left = declared.join(used.select(F.col("workspace").alias("__w"), F.col("dep").alias("__d")).distinct(), (F.col("workspace") == F.col("__w")) & (F.col("dep") == F.col("__d")), "left_anti")
    if exempt is not None:
        left = left.join(exempt.select(F.col("dep").alias("__e")), F.col("dep") == F.col("__e"), "left_anti")
    return left.distinct()


def unlisted_dependencies(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Used (workspace, dep) that the workspace doesn't declare and that look like packages."""
    left = used.where(looks_like_package(F.col("dep"))).select("workspace", "dep").distinct()
    return left.join(declared.select(F.col("workspace").alias("__w"), F.col("dep").alias("__d")).distinct(), (F.col("workspace") == F.col("__w")) & (F.col("dep") == F.col("__d")), "left_anti")


def unused_packages(files: DataFrame, reached: DataFrame) -> DataFrame:
    """Packages of which no file is reached."""
    marked = files.join(shuffled(reached.select(F.col("node").alias("__n")).distinct()), F.col("file_id") == F.col("__n"), "left")
    return marked.groupBy("package").agg(F.count("*").alias("files"), F.bool_or(F.col("__n").isNotNull()).alias("alive")).where("not alive").drop("alive")


def duplicate_exports(reexports: DataFrame) -> DataFrame:
    """Origins (source, original) that are exported under two or more (file, name); stars don't count."""
    rows = reexports.where("not is_star").groupBy("source", "original").agg(F.sort_array(F.collect_set(F.struct("reexporter", "exported"))).alias("paths"))
    return rows.where(F.size("paths") >= 2)


def impact(reached_by: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per target: how many files and which packages and entry kinds depend on it. reached_by: target, node."""
    inside = reached_by.join(shuffled(files), F.col("node") == F.col("file_id")).groupBy("target").agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_set("package")), ",").alias("packages"))
    kinds = reached_by.join(shuffled(entries.select(F.col("file_id").alias("__e"), "kind")), F.col("node") == F.col("__e")).groupBy(F.col("target").alias("__t")).agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("entry_kinds"))
    return inside.join(shuffled(kinds), F.col("target") == F.col("__t"), "left").select("target", "files", "packages", F.coalesce("entry_kinds", F.lit("")).alias("entry_kinds"))


def owned(files: DataFrame, teams: list[tuple[str, str]], codeowners: list[tuple[str, str]], packages: list[tuple[str, str]] = ()) -> DataFrame:
    """``files`` with ``owner``: the first team by name whose glob or ``packages`` (team, name) fits, else the last fitting code owners' rule.

    The rules are few and known on the driver, so they become one expression: no join.
    """
    from graphloom.functions.globs import glob_regex, owner_glob

    path = F.col("rel_path")
    tests = sorted([(team, path.rlike(glob_regex(g))) for team, g in teams] + [(team, F.coalesce(F.col("package") == p, F.lit(False))) for team, p in packages], key=lambda t: t[0])
    tests += [(owner, path.rlike(owner_glob(g))) for g, owner in reversed(codeowners)]
    out = F.lit(None).cast("string")
    for owner, fits in reversed(tests):
        out = F.when(fits, F.lit(owner)).otherwise(out)
    return files.withColumn("owner", out)


def cross_owner(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct (src, dst, src_owner, dst_owner) of edges between files of different owners."""
    a = owners.select(F.col("file_id").alias("__a"), F.col("owner").alias("src_owner"))
    b = owners.select(F.col("file_id").alias("__b"), F.col("owner").alias("dst_owner"))
    both = edges.join(a, F.col("src") == F.col("__a")).join(b, F.col("dst") == F.col("__b"))
    return both.where("src_owner <> dst_owner").select("src", "dst", "src_owner", "dst_owner").distinct()


def owner_hotspots(crossing: DataFrame) -> DataFrame:
    """Targets that files of two or more other owners import."""
    return crossing.groupBy("dst").agg(F.count_distinct("src_owner").alias("owners"), F.count("*").alias("edges")).where("owners >= 2")
