"""Written tables that cut lineage between the rounds of a fixpoint and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join that moves both sides between executors, and nothing through the driver."""
    return table.hint("merge")


def dealt(table: DataFrame, *by: str) -> DataFrame:
    """``table`` in as many tasks as a shuffle has, for work that is large for its bytes; small partitions aren't put together."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows made of a few large ones, some thousands at a time."""
    left = iter(rows)
    while part := list(islice(left, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


class Rounds:
    """Writes tables to the folder that all executors share (``spark.checkpoint.dir``)."""

    def __init__(self, spark: SparkSession) -> None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            spark.conf.set("spark.checkpoint.dir", folder)
        self.spark, self.root, self.n = spark, f"{folder}/graphloom/{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        return self.counted(df)[0]

    def counted(self, df: DataFrame, count: Column | None = None) -> tuple[DataFrame, int]:
        """The written table, and how many rows it has (of those that ``count`` holds for); the write itself counts them."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        seen = Observation()
        df.observe(seen, F.count_if(F.lit(True) if count is None else count).alias("n")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.graphloom_path = path
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that nothing reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            at = jvm.org.apache.hadoop.fs.Path(table.graphloom_path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
