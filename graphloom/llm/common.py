"""What the operators of this subpackage share: written intermediates, word and shingle hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and the least similarity (in hundredths) of near duplicates.
SHINGLE_WORDS = 5
NEAR_PERCENT = 75
#: Most keys whose rows are joined by a broadcast because they are so many.
HOT = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one (driver and executors are one machine there).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Workspace:
    """Written tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it again."""
        path = self.path(name)
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.graphloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that no later read needs."""
        jvm = self.spark._jvm
        for table in tables:
            at = jvm.org.apache.hadoop.fs.Path(table.graphloom_path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def joined_by_key(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, n_rows: int) -> DataFrame:
    """The inner join of ``rows`` with ``groups``, which has one row for each key and the number of ``rows`` with it in ``count``.

    Keys with more than a ``HOT``-th of all ``n_rows`` (256 rows at least) are fewer than ``HOT``: they are broadcast and their rows are
    not shuffled. So no task gets more than that share of one key, however uneven the keys are.
    """
    many = max(256, n_rows // HOT)
    hot = F.broadcast(groups.where(F.col(count) > many).drop(count))
    rest = groups.where(F.col(count) <= many).drop(count)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def unused_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, upper and lower case taken as equal."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text each, so that what is built from one stays small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def freed() -> None:
    """Gives free memory back to the system at a task's end: Python workers live on, several to a core, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


class HashCache(dict):
    """Word (bytes) to its 64-bit hash; emptied when it holds ``most`` words, so its memory is bounded."""

    def __init__(self, most: int = 150_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 (a multiply and shift finaliser)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words, from the words' hashes."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total = mixed(total + words[k : k + len(total)] * _ODD[k % len(_ODD)])
    return total


def shingle_set(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than ``n`` words make one shingle, none make none."""
    if not len(words):
        return words
    return np.unique(gram_hashes(words, n if len(words) >= n else len(words)))
