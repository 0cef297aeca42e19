"""Token counts of flat token files, by separators.

A flat file is nothing but token ids, little-endian and of one width, with an end-of-document id after each document: no index. Files
are cut into blocks at any place. Each block is searched for separators as one vector; what it tells is small: its tokens, its
separators' places. A document that crosses blocks is put together by a prefix scan over the blocks of a file: the running number of
separators gives the documents' ordinals, and the running place of the last separator gives where an open document began.

``write_flat`` writes such files with Spark's text writer: a row is a document's ids, and the line separator is the separator id itself.
The same pass writes the documents' ids beside them, so nothing is numbered again.

Defined cases: a null or empty text is a document of no tokens, a null id stays null, repeated rows are each a document; an empty file or
table has none; a text of any length is one row of one task; tokens after a file's last separator are an unfinished document, given with
``complete`` false; a file with a part of an id at its end raises an error, as does one of 2 GiB or more (Spark's limit for ``binaryFile``;
``write_flat`` begins a new file after ``FILE_BYTES``); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import encoder
from graphloom.llm.common import Workspace, exists, freed, slices

BLOCK = 1 << 20
#: Bytes of ids after which a partition's next file begins; a file ends with the slice of documents (about 4 MiB of text) that passes them.
FILE_BYTES = 1 << 30
#: The folders of what ``write_flat`` writes. Numbers, as the writer would sort by a text column again.
TOKENS, IDS = 0, 1


def _separator(end_id: int, width: str) -> str:
    return np.array([end_id], width).tobytes().decode("latin-1")


def id_width(n_ids: int) -> str:
    """The width of flat files with so many ids."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def write_flat(docs: DataFrame, path: str, vocabulary: str, pattern: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Flat files of ids in ``kind=0``, one or more per partition, and in ``kind=1`` each document's id and place in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, pattern)
        width = id_width(end_id + 1)
        if end_id < len(bpe.pieces):
            raise ValueError("the separator is an id of the vocabulary")
        at = piece = filled = 0
        for whole in batches:
            for batch in slices(whole, 1):
                tokens = bpe.encode_many(batch.column(1).to_pylist())
                if width != bpe.width:
                    tokens = [np.frombuffer(x, bpe.width).astype(width).tobytes() for x in tokens]
                ids = [f"{at + k} {'' if d is None else d}".encode() for k, d in enumerate(batch.column(0).to_pylist())]
                n = len(ids)
                places = np.arange(at, at + n)
                yield pa.RecordBatch.from_arrays([pa.array([TOKENS] * n + [IDS] * n, pa.int32()), pa.array([piece] * 2 * n, pa.int32()), pa.array(np.concatenate([places, places])), pa.array(tokens + ids, pa.binary())], ["kind", "piece", "at", "value"])
                at, filled = at + n, filled + sum(map(len, tokens)) + n * np.dtype(width).itemsize
                if filled >= FILE_BYTES:
                    at, filled, piece = 0, 0, piece + 1
        bpe.forget()
        freed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind int, piece int, at long, value binary")
    # Each task writes both files of its partition, in the documents' order.
    lines = rows.sortWithinPartitions("kind", "piece", "at").select("kind", "piece", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("kind", "piece").option("lineSep", _separator(end_id, id_width(end_id + 1))).option("encoding", "ISO-8859-1").text(path)


#: A written file's partition and its number among the partition's files.
_PART, _PIECE = r"/part-(\d+)-[^/]*$", r"/piece=(\d+)/[^/]*$"


def _numbered(rows: DataFrame, file: str) -> DataFrame:
    number = lambda p: F.regexp_extract(file, p, 1).cast("int")
    return rows.withColumns({"part": number(_PART), "piece": number(_PIECE)})


def document_ids(spark: SparkSession, path: str, *, end_id: int) -> DataFrame:
    """Rows (part, piece, at, doc_id) of what ``write_flat`` wrote: which document stands where in its partition."""
    lines = spark.read.option("lineSep", _separator(end_id, id_width(end_id + 1))).option("encoding", "ISO-8859-1").text(f"{path}/kind={IDS}")
    both = F.split("value", " ")
    return _numbered(lines.select("value", F.col("_metadata.file_path").alias("file")), "file").select("part", "piece", both[0].cast("long").alias("at"), F.nullif(both[1], F.lit("")).cast("long").alias("doc_id"))


def document_counts(spark: SparkSession, path: str, *, end_id: int, space: Workspace | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, part, piece, at, start) of what ``write_flat`` wrote; a document without tokens' file, or the other way round, raises an error."""
    if not exists(spark, f"{path}/kind={TOKENS}"):
        return spark.createDataFrame([], "doc_id long, n_tokens long, part int, piece int, at long, start long")
    found = _numbered(scan_files(spark, f"{path}/kind={TOKENS}", end_id=end_id, width=id_width(end_id + 1), space=space), "file")
    at = F.col("ordinal").cast("long").alias("at")
    both = found.select("part", "piece", at, "start", "n_tokens", "complete").join(document_ids(spark, path, end_id=end_id).withColumn("there", F.lit(True)), ["part", "piece", "at"], "full_outer")
    fits = F.when(F.col("there").isNull() | F.col("complete").isNull() | ~F.col("complete"), F.raise_error(F.lit("the flat files don't hold the documents written")).cast("long")).otherwise(F.col("n_tokens"))
    return both.select("doc_id", fits.alias("n_tokens"), "part", "piece", "at", "start")


def scan_files(spark: SparkSession, path: str, *, end_id: int, block: int = BLOCK, width: str = "<u2", space: Workspace | None = None) -> DataFrame:
    """Rows (file, ordinal, start, n_tokens, complete), one per document of the files in a folder."""
    space = space or Workspace(spark, "scan")
    size = np.dtype(width).itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    number = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((length - 1) div {block * size} as int)"))))
    blocks = files.select("file", "length", "content", number.alias("block")).select("file", "length", "block", F.expr(f"substring(content, block * {block * size} + 1, {block * size})").alias("content"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places = [], []
            for length, content in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                if length % size:
                    raise ValueError("a file ends inside an id")
                ids = np.frombuffer(content.as_buffer(), width)
                tokens.append(len(ids))
                places.append(np.flatnonzero(ids == end_id).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["file", "block", "n", "places"])

    found = space.table(blocks.mapInArrow(search, "file string, block int, n long, places array<int>"), "blocks")
    # The prefix scan sees three numbers of a block, not its separators: so a file of any length is little to it.
    each = Window.partitionBy("file").orderBy("block")
    before = each.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    told = found.select("file", "block", "n", F.size("places").alias("k"), F.element_at(F.concat("places", F.array(F.lit(-1))), F.greatest(F.size("places"), F.lit(1))).alias("last"))
    placed = told.withColumns({"first": first, "seps": F.coalesce(F.sum("k").over(before), F.lit(0))}).withColumn("ends", F.when(F.col("k") > 0, F.col("first") + F.col("last") + 1))
    scanned = placed.withColumns({"open": F.coalesce(F.max("ends").over(before), F.lit(0)), "final": F.lead("block").over(each).isNull()})
    # Inside a block, a document runs from the separator before it (or where it was open) to its own; after the last block, what is left is unfinished.
    inside = found.select("file", "block", "places").join(scanned.where("k > 0").select("file", "block", "first", "seps", "open"), ["file", "block"])
    inside = inside.select("file", "open", "first", "seps", "places", F.posexplode("places").alias("k", "place"))
    start = F.when(F.col("k") > 0, F.col("first") + F.element_at("places", F.greatest(F.col("k"), F.lit(1))) + 1).otherwise(F.col("open"))
    done = inside.select("file", (F.col("seps") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("first") + F.col("place") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    begun = F.coalesce("ends", "open")
    rest = scanned.where("final").select("file", (F.col("seps") + F.col("k")).alias("ordinal"), begun.alias("start"), (F.col("first") + F.col("n") - begun).alias("n_tokens"), F.lit(False).alias("complete")).where("n_tokens > 0")
    return done.unionByName(rest)
