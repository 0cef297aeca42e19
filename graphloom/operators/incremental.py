"""Maintenance of what a graph reaches when edges and seeds change: over-delete, then re-derive, without a rebuild.

1. What might be lost: all that old edges reach from the ends of deleted edges and from deleted seeds, among what was reached.
2. What stays for sure is the rest. From it, new edges lead back to lost nodes, and to new ones; these, and the seeds that aren't in it, are where
   the search goes on, over new edges that don't end in what stays.

Both searches touch only what the change touches, so a small change costs a small fixpoint, however large the graph is. ``stored_facts`` is the other
half: facts of texts are kept by path and digest, and only texts that the store doesn't know are read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import reach
from graphloom.operators.tables import Rounds, shuffled


def reached_after(old_edges: DataFrame, new_edges: DataFrame, old_seeds: DataFrame, new_seeds: DataFrame, reached: DataFrame) -> DataFrame:
    """(node) that ``new_seeds`` reach over ``new_edges``, from ``reached`` (node), what ``old_seeds`` reached over ``old_edges``. Edges: src, dst."""
    rounds = Rounds(reached.sparkSession)
    old, new = (e.select("src", "dst").distinct() for e in (old_edges, new_edges))
    was = reached.select("node").distinct()
    gone = old.join(shuffled(new), ["src", "dst"], "left_anti").join(shuffled(was.withColumnRenamed("node", "src")), "src", "left_semi").select(F.col("dst").alias("node"))
    unseeded = old_seeds.select("node").join(shuffled(new_seeds.select("node")), "node", "left_anti")
    doubtful = rounds.table(gone.unionByName(unseeded).distinct())
    lost = rounds.table(reach(old, doubtful).select("node"))
    stays = rounds.table(was.join(shuffled(lost), "node", "left_anti"))
    outside = rounds.table(new.join(shuffled(stays.withColumnRenamed("node", "dst")), "dst", "left_anti").select("src", "dst"))
    entered = outside.join(shuffled(stays.withColumnRenamed("node", "src")), "src", "left_semi").select(F.col("dst").alias("node"))
    begins = entered.unionByName(new_seeds.select("node").join(shuffled(stays), "node", "left_anti")).distinct()
    return stays.unionByName(reach(outside, begins).select("node"))


def stored_facts(sources: DataFrame, store: str, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Facts of ``sources`` (rel_path, text), and how many texts had to be read for them.

    ``extract`` makes rows with ``rel_path`` of such sources. The folder ``store`` holds a list of the (rel_path, digest) read and their facts, and grows by
    what is new; a lost write leaves facts without a list entry, which are read again and count once. The facts returned name their files, as Spark takes two reads
    of one folder for the same, whatever was added between them.
    """
    spark = sources.sparkSession
    rounds = Rounds(spark)
    keyed = sources.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    now = rounds.table(keyed.select("rel_path", "digest").distinct())
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    known = spark.read.parquet(f"{store}/known") if fs.exists(path(f"{store}/known")) else now.limit(0)
    fresh, n = rounds.counted(now.join(known, ["rel_path", "digest"], "left_anti"))
    if n:
        asked = keyed.join(fresh, ["rel_path", "digest"], "left_semi")
        found = extract(asked.select("rel_path", "text")).join(fresh, "rel_path")
        found.write.mode("append").parquet(f"{store}/facts")
        fresh.write.mode("append").parquet(f"{store}/known")
    if n or not known.isEmpty():
        there = [s.getPath() for s in fs.listStatus(path(f"{store}/facts"))]
        return spark.read.parquet(*[p.toString() for p in there if p.getName()[0] not in "_."]).join(now, ["rel_path", "digest"], "left_semi").distinct(), n
    return extract(sources.limit(0)).withColumn("digest", F.lit("")), n
