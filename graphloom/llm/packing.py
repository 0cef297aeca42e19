"""Packing of token ids into rows of one length by best-fit decreasing.

Documents longer than a row are split into full rows and a rest, without loss. Inside a block of documents the pieces are placed from
the longest to the shortest, each in the row of least free space that still holds it; a segment tree over the amounts of free space
finds that amount in as many steps as a row's length has bits. A block is what one task reads in a bounded number of documents and
tokens, so nothing is shuffled and memory doesn't follow the input; only the last rows of a block stay partly empty.

A packed row has its ids as a little-endian matrix row padded with the end-of-document id, the cumulative segment lengths (from 0), the
positions (0 again at each segment's start; padding is a segment of its own that restarts too) and, for every segment, its document
and where the segment starts in the document's ids.

``write_matrices`` writes packed rows as flat matrices; ``read_matrices`` reads them.

Defined cases: null and empty texts have no ids and no segment; a null id packs with a null document; repeated rows pack each; pieces of
one length keep the order of their documents; a text of any length is split over as many rows as it needs (one task holds it); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import encoder
from graphloom.llm.common import Workspace, freed, slices

ROW_TOKENS = 2048
#: Most documents and tokens of a block.
BLOCK_DOCS, BLOCK_TOKENS = 16_384, 4 << 20


class CapacityTree:
    """A segment tree over the amounts of free space 0 to ``most``: how many rows have each amount."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = free + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (free, row) of the least free space that is ``least`` or more."""
        node = least + self.size
        if least >= self.size:
            return None
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return free, self.rows[free].pop()


def best_fit(lengths: np.ndarray, row: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length) pieces, longest pieces first."""
    pieces = [(row, d, at) for d, n in enumerate(lengths.tolist()) for at in range(0, n - row + 1, row)]
    rests = [(n % row, d, n - n % row) for d, n in enumerate(lengths.tolist()) if n % row]
    out = [[(d, at, n)] for n, d, at in pieces]
    tree = CapacityTree(row)
    for n, d, at in sorted(rests, key=lambda r: (-r[0], r[1])):
        found = tree.take(n)
        if found is None:
            free, k = row, len(out)
            out.append([])
        else:
            free, k = found
        out[k].append((d, at, n))
        if free > n:
            tree.add(free - n, k)
    return out


def packed_rows(docs: DataFrame, path: str, pattern: str, *, row_tokens: int = ROW_TOKENS, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row: shard, row, n_tokens, doc_ids, doc_starts, cu_lengths, ids binary, positions binary (uint16 or uint32, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        end = len(bpe.pieces) if end_id is None else end_id
        width = np.dtype(bpe.width)
        shard, made = TaskContext.get().partitionId(), 0
        places = np.arange(row_tokens, dtype=width)
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, tokens
            rows = best_fit(np.array([len(x) for _, x in held], np.int64), row_tokens)
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                ids = np.full((len(part), row_tokens), end, width)
                positions = np.zeros((len(part), row_tokens), width)
                columns: dict[str, list] = {k: [] for k in ("n_tokens", "doc_ids", "doc_starts", "cu_lengths")}
                for k, pieces in enumerate(part):
                    cu = [0]
                    for d, start, n in pieces:
                        a = cu[-1]
                        ids[k, a : a + n] = held[d][1][start : start + n]
                        positions[k, a : a + n] = places[:n]
                        cu.append(a + n)
                    positions[k, cu[-1] :] = places[: row_tokens - cu[-1]]
                    columns["n_tokens"].append(cu[-1])
                    columns["doc_ids"].append([held[d][0] for d, _, _ in pieces])
                    columns["doc_starts"].append([start for _, start, _ in pieces])
                    columns["cu_lengths"].append(cu)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(part), pa.int32()), pa.array(range(made, made + len(part)), pa.int64()), pa.array(columns["n_tokens"], pa.int32()),
                    pa.array(columns["doc_ids"], pa.list_(pa.int64())), pa.array(columns["doc_starts"], pa.list_(pa.int64())), pa.array(columns["cu_lengths"], pa.list_(pa.int32())),
                    pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in positions], pa.binary()),
                ], ["shard", "row", "n_tokens", "doc_ids", "doc_starts", "cu_lengths", "ids", "positions"])
                made += len(part)
            held.clear()
            tokens = 0

        for whole in batches:
            for batch in slices(whole, 1):
                for doc, raw in zip(batch.column(0).to_pylist(), bpe.encode_many(batch.column(1).to_pylist()), strict=True):
                    if raw:
                        held.append((doc, np.frombuffer(raw, width)))
                        tokens += len(raw) // width.itemsize
                    if len(held) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                        yield from flush()
        bpe.forget()
        yield from flush()
        freed()

    schema = "shard int, row long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_lengths array<int>, ids binary, positions binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def write_matrices(packed: DataFrame, path: str, *, end_id: int, width: str = "<u2") -> None:
    """Writes packed rows to a folder: ``rows`` (a table of shard, row, n_tokens and the segments) and flat files ``ids`` and ``positions``.

    A flat file holds one shard's rows in order and nothing else: little-endian ids (or positions) of a row and then ``end_id``, so row n is
    found by its place. Spark's text writer makes them, with that last column as its line separator, so they go wherever Spark writes.
    """
    # Written once: packing twice could split the documents otherwise.
    space = Workspace(packed.sparkSession, "matrices")
    whole = space.table(packed, "packed")
    whole.drop("ids", "positions").write.parquet(f"{path}/rows")
    ordered = whole.repartition("shard").sortWithinPartitions("shard", "row")
    last = np.array([end_id], width).tobytes().decode("latin-1")
    for name in ("ids", "positions"):
        rows = ordered.select("shard", F.col(name).cast("string").alias("value"))
        rows.write.partitionBy("shard").option("lineSep", last).option("encoding", "ISO-8859-1").text(f"{path}/{name}")
    space.drop(whole)


def read_matrices(spark: SparkSession, path: str, *, row_tokens: int = ROW_TOKENS, width: str = "<u2") -> DataFrame:
    """The packed rows of such a folder."""
    size = row_tokens * np.dtype(width).itemsize
    step = size + np.dtype(width).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                if len(raw) % step:
                    raise ValueError("a matrix ends inside a row")
                for at in range(0, len(raw) // step, 512):
                    rows = range(at, min(at + 512, len(raw) // step))
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), pa.array(rows, pa.int64()), pa.array([raw[r * step : r * step + size].to_pybytes() for r in rows], pa.binary())], ["shard", "row", "value"])

    out = spark.read.parquet(f"{path}/rows")
    for name in ("ids", "positions"):
        if out.isEmpty():  # then no file was written
            out = out.withColumn(name, F.lit(None).cast("binary"))
            continue
        files = spark.read.format("binaryFile").load(f"{path}/{name}").select("shard", "content")
        out = out.join(files.mapInArrow(cut, "shard int, row long, value binary").withColumnRenamed("value", name), ["shard", "row"])
    return out
