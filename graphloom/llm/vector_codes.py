"""Compression of vectors to codes of 16 bytes: codebooks by integer Lloyd rounds, nearest entries by exponion search.

Components become integers floor(256 x). A vector is cut into 16 equal parts, and each part position has a codebook of up to 64 entries. All
distances are squared Euclidean ones of integers, so they are exact, and ties go to the lower index.

Search starts at the part's previous entry a, at distance u. An entry further than 2u from a is further than u from the part (triangle
inequality), so only the entries inside that radius are compared: a prefix of the list of entries sorted by their distance from a. In squares
that is d(a, j)^2 <= 4 u^2, still in integers; entries on the rim are compared too, as they may tie.

Every round writes the vectors with their codes once; sums and counts of entries are added up in tasks and then by (part, entry), so the driver
gets at most 16 x 64 rows of them, and codebooks (16 x 64 x a part's components) travel with the tasks.

Defined cases: vectors that are null, empty or hold null or non-finite components are dropped, and so are those whose length isn't the one
of the least kept id or no multiple of 16; components are held within 2^25 of zero after scaling (so that all sums of squares are exact and an error
fits a long). Rows with a null id are coded, but start no codebook; of rows that repeat an id the least vector starts one. Fewer than 64
ids make a smaller codebook. Null labels are one label. An empty table gives no rows. Other columns are left out of the result, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Workspace, freed, joined_by_key

PARTS, ENTRIES, ROUNDS, SCALE, MOST = 16, 64, 2, 256, 1 << 25


def integers(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): the rows whose vectors count, with their components as integers."""
    x = F.col("v")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-MOST)), F.lit(MOST))).cast("int"))
    out = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return out.where(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(odd, F.lit(True))).withColumn("v", whole)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def first_vectors(found: DataFrame, most: int = ENTRIES) -> list[list[int]]:
    """The vectors of the ``most`` least ids; every task hands on its own ``most``, with each id's least vector."""
    kind = found.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, list[int]] = {}
        last = None
        for batch in batches:
            ids = batch.column(0)
            close = pc.less_equal(ids, pa.scalar(last, ids.type)) if last is not None else None
            part = batch.filter(close) if close is not None else batch
            for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if i not in best or v < best[i]:
                    best[i] = v
            if len(best) > most:
                best = dict(sorted(best.items())[:most])
            if len(best) == most:
                last = max(best)
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), batch_type(kind)), pa.array(best.values(), pa.list_(pa.int32()))], ["vec_id", "v"])

    rows = found.where("vec_id is not null").select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, v array<int>")
    return [r["v"] for r in rows.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(most).collect()]


def batch_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]


@dataclass
class Codebooks:
    """``entries`` has (part, entry, component); ``near`` the entries of each part by their distance from each, and ``far`` these squared distances."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        gap = self.entries[:, :, None, :] - self.entries[:, None, :, :]
        square = (gap * gap).sum(-1)
        self.near = np.argsort(square, axis=2, kind="stable")
        self.far = np.take_along_axis(square, self.near, 2)

    def search(self, vectors: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), each (row, part), of vectors (row, component) from the entries in ``start``."""
        parts, many, width = self.entries.shape
        codes, errors = np.empty_like(start), np.empty(start.shape, np.int64)
        for p in range(parts):
            x, entries = vectors[:, p * width : (p + 1) * width], self.entries[p]
            here = x - entries[start[:, p]]
            u = (here * here).sum(1)
            order = np.argsort(start[:, p], kind="stable")
            ends = np.searchsorted(start[order, p], np.arange(many + 1))
            for a in np.unique(start[:, p]):
                rows = order[ends[a] : ends[a + 1]]
                reach = np.searchsorted(self.far[p, a], 4 * u[rows], side="right")  # entries inside the radius
                by_reach = np.argsort(-reach, kind="stable")
                rows, reach = rows[by_reach], reach[by_reach]
                best, code = u[rows], np.full(len(rows), a)
                points = x[rows]
                left = len(rows)
                for k in range(1, int(reach[0])):
                    left = int(np.searchsorted(-reach[:left], -k, side="left"))  # rows that compare more than k entries
                    j = self.near[p, a, k]
                    gap = points[:left] - entries[j]
                    d = np.einsum("ij,ij->i", gap, gap)
                    better = (d < best[:left]) | ((d == best[:left]) & (j < code[:left]))
                    best[:left][better] = d[better]
                    code[:left][better] = j
                # The entry at the list's head is a itself, or an equal one of lower index.
                j = self.near[p, a, 0]
                code = np.where((self.far[p, a, 0] == 0) & (best == u[rows]) & (j < code), j, code)
                codes[rows, p], errors[rows, p] = code, best
        return codes, errors

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def coded(found: DataFrame, books: Codebooks) -> DataFrame:
    """``found`` (vec_id, label, v, code) with new codes, from the old ones, and ``error``."""
    dims = books.entries.shape[0] * books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
            codes, errors = books.search(matrix(batch.column("v"), dims), old)
            packed = codes.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(errors.sum(1), pa.int64())], ["vec_id", "label", "v", "code", "error"])
        freed()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields if f.name in ("vec_id", "label"))
    return found.mapInArrow(run, f"{kinds}, v array<int>, code binary, error long")


def moved(books: Codebooks, found: DataFrame) -> Codebooks:
    """Codebooks whose used entries are the floors of the means of their parts."""
    parts, many, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, many), np.int64), np.zeros((parts, many, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, PARTS)
                v = matrix(batch.column(1), parts * width).reshape(-1, parts, width)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=many)
                    np.add.at(sums[p], codes[:, p], v[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    rows = found.select("code", "v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    entries = books.entries.copy()
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # a row for each entry
        entries[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return Codebooks(entries)


def compressed(rows: DataFrame, *, space: Workspace | None = None, rounds: int = ROUNDS, **columns: str) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of the kept rows, and the final codebooks (None of no rows)."""
    space = space or Workspace(rows.sparkSession, "vectors")
    found = integers(rows, **columns)
    first = first_vectors(found)
    first = [v for v in first if len(v) == len(first[0])] if first else []
    if not first or len(first[0]) % PARTS:
        none = found.where(F.lit(False)).select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return none, None
    dims = len(first[0])
    books = Codebooks(np.array(first, np.int64).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2))
    last = found.where(F.size("v") == dims).withColumn("code", F.lit(bytes(PARTS)))
    written = None
    for _ in range(rounds):
        table = space.table(coded(last, books).drop("error"), "codes")
        books = moved(books, table)
        if written is not None:
            space.drop(written)
        last = written = table
    return coded(last, books).drop("v"), books


def with_label_error(found: DataFrame, space: Workspace) -> DataFrame:
    """``found`` with ``label_error``, the errors summed over the rows of a label."""
    found = space.table(found.select("*", F.col("label").isNull().alias("__none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("__label")), "errors")
    sums = found.groupBy("__none", "__label").agg(F.count("*").alias("__n"), F.sum("error").alias("label_error"))
    sums = space.table(sums, "labels")
    return joined_by_key(found, sums, ["__none", "__label"], "__n", found.count()).drop("__none", "__label")
