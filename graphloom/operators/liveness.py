"""Symbol liveness: which exports are wanted, through re-exports, to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import fixpoint
from graphloom.operators.tables import Rounds, shuffled


def demand(imports: DataFrame, reexports: DataFrame, reachable: DataFrame, entries: DataFrame | None, member_refs: DataFrame | None = None) -> DataFrame:
    """Rows (file, is_type, name) that are wanted; the name ``*`` wants all.

    imports: importer, source, name, is_type. reexports: reexporter, source, original, exported, is_star, is_type. reachable: file.
    entries: files whose exports are all wanted, or None if entry exports are to be judged too. member_refs: file, alias, member.
    A true star passes every wanted name on, a namespace passes on the members used of it, a named re-export its original name.
    """
    rounds = Rounds(imports.sparkSession)
    there = reachable.select(F.col("file").alias("__r")).distinct()
    first = imports.join(shuffled(there), F.col("importer") == F.col("__r"), "left_semi").select(F.col("source").alias("file"), "is_type", "name")
    if entries is not None:
        both = F.explode(F.array(F.lit(False), F.lit(True))).alias("is_type")
        first = first.unionByName(entries.select("file", both, F.lit("*").alias("name")))
    links = rounds.table(reexports.join(shuffled(there), F.col("reexporter") == F.col("__r"), "left_semi").select("reexporter", F.col("source").alias("__source"), "original", "exported", "is_star", F.col("is_type").alias("__type")))
    refs = None if member_refs is None else member_refs.toDF("__f", "__alias", "__member")

    def passed_on(rows: DataFrame, now: Column, then: Column) -> DataFrame:
        met = rows.join(shuffled(links), (F.col("file") == F.col("reexporter")) & (F.col("is_type") == F.col("__type")) & now, "left")
        named = (F.col("name") == "*") | (F.col("name") == F.col("exported"))
        star = F.col("is_star") & (F.col("exported") == "*")
        through = F.when(star, F.col("name")).when(named & ~F.col("is_star"), F.col("original"))
        if refs is not None:
            met = met.join(shuffled(refs), (F.col("file") == F.col("__f")) & (F.col("exported") == F.col("__alias")) & F.col("is_star") & ~star & named, "left")
            through = F.coalesce(through, F.col("__member"))
        own = F.struct("file", "is_type", "name", "hop")
        behind = F.when(through.isNotNull(), F.struct(F.col("__source").alias("file"), "is_type", through.alias("name"), then.alias("hop")))
        return met.select(F.explode(F.array_compact(F.array(own, behind))).alias("__e")).select("__e.*")

    return fixpoint(rounds, first, passed_on, ["file", "is_type", "name"]).drop("hop")


def live_exports(exports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exports (file, name, is_type) that are wanted as values or as types, one row each."""
    names = wanted.select(F.col("file").alias("__f"), F.col("name").alias("__n")).distinct()
    one = exports.join(shuffled(names.where("__n <> '*'")), (F.col("file") == F.col("__f")) & (F.col("name") == F.col("__n")), "left_semi")
    every = exports.join(shuffled(names.where("__n = '*'")), F.col("file") == F.col("__f"), "left_semi")
    return one.unionByName(every).distinct()


def unused_members(members: DataFrame, refs: DataFrame) -> DataFrame:
    """Members (file, parent, member) that nobody reads, of parents with some that somebody reads."""
    read = refs.where("access <> 'write'").select("file", "parent", "member").distinct().withColumn("__live", F.lit(1))
    marked = members.select("file", "parent", "member").distinct().join(shuffled(read), ["file", "parent", "member"], "left").withColumn("__live", F.coalesce("__live", F.lit(0)))
    partly = marked.groupBy("file", "parent").agg(F.sum("__live").alias("live"), F.count("*").alias("n")).where("live > 0 and live < n").select("file", "parent")
    return marked.where("__live = 0").join(shuffled(partly), ["file", "parent"], "left_semi").select("file", "parent", "member")
