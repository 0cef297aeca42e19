"""Substring de-duplication by hashing lines and the sentences in them.

A text is cut into fragments: at line breaks, after sentence ends, and before a word that begins with a capital letter, so that a passage
put into the middle of a line begins a fragment of its own. Each fragment's least run forward, and least run back, of ``UNIT_WORDS`` words
or more is a unit; a unit is normalised (A-Z lower-cased, white space collapsed) and hashed to 128 bits. Digests are grouped over all
documents. Of all units with one digest the earliest in the order (document id, place) is kept; fragments in the others are copied
fragments. Runs of copied fragments with ``PASSAGE_WORDS`` words or more together are removed, shorter ones are chance and stay. A removed
run's fragments each stand in an earlier unit, so some earliest text of each is always kept.

Digests are counted with a partial aggregate before the shuffle. Those that very many documents have are
broadcast, the others are joined by digest (see ``joined_by_key``), so no task gets more than a small share of the rows of one digest,
and no group's members are ever listed. Copies inside a document are settled where the document is read.

Offsets are in code points of the original text; a removed run goes with the white space after it, the rest keeps its order and bytes.

Defined cases: a null text stays null, an empty one empty; a null id ranks behind all others; rows that repeat an id (or have none) rank by
their text's hash, and equal ones in the order they are written in; a text of any length is one task's row; an empty table gives an empty
result. Input columns named like an output are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Workspace, joined_by_key, unused_name

#: Least words of a unit, and of a run of copied fragments that goes. A passage whose edges lie inside sentences has fewer words in whole ones.
UNIT_WORDS, PASSAGE_WORDS = 8, 40
_WHITE = r"[\x20\x09-\x0D]"
_CUT = regex.compile(rf"(?<=[.!?]){_WHITE}+|{_WHITE}+(?=\p{{Lu}})|[\x20\x09\x0B-\x0D]*\n{_WHITE}*")


def fragments(text: str) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of every fragment that has words; the end is behind the white space that follows."""
    out, start = [], 0
    for end in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        if words := text[start:end].encode().lower().split():
            out.append((start, end, words))
        start = end
    return out


def unit_spans(counts: list[int], least: int) -> list[tuple[int, int]]:
    """The units (first fragment, end) of fragments with so many words, in order."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    ends = np.searchsorted(upto, upto[:-1] + least)
    starts = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    forward = {(a, b) for a, b in enumerate(ends.tolist()) if b < len(upto)}
    return sorted(forward.union((a, b) for b, a in enumerate(starts.tolist(), 1) if a >= 0))


def unit_digests(found: list[tuple[int, int, list[bytes]]], least: int) -> list[tuple[bytes, int, int]]:
    """(digest, first fragment, end) of the units."""
    texts = [b" ".join(words) for _, _, words in found]
    return [(xxhash.xxh3_128_digest(b" ".join(texts[a:b])), a, b) for a, b in unit_spans([len(words) for _, _, words in found], least)]


def copied_runs(text: str, drop: set[bytes], unit_words: int, passage_words: int) -> list[tuple[int, int]]:
    """The offsets of what goes: runs of fragments in units that are in ``drop``, or that the text has before (less the first one's fragments)."""
    found = fragments(text)
    copied = [False] * len(found)
    first: dict[bytes, int] = {}
    for digest, a, b in unit_digests(found, unit_words):
        if digest not in drop:
            a = max(a, first.setdefault(digest, b))
        if a < b:
            copied[a:b] = [True] * (b - a)
    out, k = [], 0
    while k < len(found):
        end = k
        while end < len(found) and copied[end]:
            end += 1
        if end > k and sum(len(words) for _, _, words in found[k:end]) >= passage_words:
            out.append((found[k][0], found[end - 1][1]))
        k = end + 1
    return out


def ranked(docs: DataFrame, rank: str, id_col: str, text_col: str, space: Workspace) -> DataFrame:
    """``docs`` with a distinct ``rank`` for every row, in the order of the ids.

    The id is its own rank if no row repeats or lacks one. Otherwise the rows are sorted by id and text and written with their numbers.
    """
    number = F.col(id_col).cast("long")
    if docs.groupBy(number.alias("id")).count().where("id is null or count > 1").isEmpty():
        return docs.withColumn(rank, number)
    order = [number.isNull(), number, F.xxhash64(text_col)]
    return space.table(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(rank, F.monotonically_increasing_id()), "ranked")


def digest_rows(texts: DataFrame, unit_words: int) -> DataFrame:
    """Rows (rank, hi, lo) of rows (rank, text): a document's distinct digests; one with null digests tells that the document repeats units itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks: list[int] = []
            parts: list[bytes] = []
            valid: list[bool] = []
            for rank, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                units = unit_digests(fragments(text.as_py()), unit_words)
                distinct = list(dict.fromkeys(d for d, _, _ in units))
                own = len(distinct) < len(units)
                ranks += [rank] * (len(distinct) + own)
                parts += distinct
                valid += [True] * len(distinct)
                if own:
                    parts.append(b"\0" * 16)
                    valid.append(False)
            raw = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
            mask = ~np.array(valid, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(raw[:, 0], mask=mask), pa.array(raw[:, 1], mask=mask)], ["rank", "hi", "lo"])

    return texts.mapInArrow(run, "rank long, hi long, lo long")


def removals(texts: DataFrame, unit_words: int, space: Workspace) -> DataFrame:
    """Rows (rank, digests) of rows (rank, text): which digests of a document an earlier one has; of those that have any or repeat units.

    A document's own list is as long as its units at most.
    """
    units = space.table(digest_rows(texts, unit_words), "units")
    each = units.where("hi is not null")
    shared = space.table(each.groupBy("hi", "lo").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n")).where("first < last").drop("last"), "shared")
    later = joined_by_key(each, shared, ["hi", "lo"], "n", units.count()).where("rank > first").drop("first")
    own = units.where("hi is null")
    return space.table(later.unionByName(own).groupBy("rank").agg(F.collect_set(F.struct("hi", "lo")).alias("digests")), "removals")


def without_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, passage_words: int = PASSAGE_WORDS, removed_col: str = "removed", number_col: str = "n_removed", space: Workspace | None = None
) -> DataFrame:
    """``docs`` whose text has lost its copies, with ``number_col`` (long) and ``removed_col`` (array of start and end of each)."""
    space = space or Workspace(docs.sparkSession, "passages")
    rank, gone, digests, cut = (unused_name(docs, n) for n in ("rank", "gone", "digests", "cut"))
    rows = ranked(docs, rank, id_col, text_col, space)
    lost = removals(rows.select(F.col(rank).alias("rank"), F.col(text_col).cast("string").alias("text")), unit_words, space)

    @F.arrow_udf("struct<text:string,removed:array<struct<start:bigint,end:bigint>>>")
    def cut_out(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for text, lost in zip(texts, lists, strict=True):
            if not lost.is_valid or not text.is_valid:
                out.append(None)
                continue
            body = text.as_py()
            drop = {np.array([d["hi"], d["lo"]], "<i8").tobytes() for d in lost.as_py() if d["hi"] is not None}
            runs = copied_runs(body, drop, unit_words, passage_words)
            kept = [body[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(body)], strict=True)]
            out.append({"text": "".join(kept), "removed": [{"start": a, "end": b} for a, b in runs]})
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.list_(span))]))

    lost = lost.select(F.col("rank").alias(gone), F.col("digests").alias(digests))
    done = rows.join(lost.hint("shuffle_hash"), F.col(rank) == F.col(gone), "left").withColumn(cut, cut_out(F.col(text_col).cast("string"), F.col(digests)))
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.col(f"{cut}.text"))
    removed = F.coalesce(F.col(f"{cut}.removed"), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return done.withColumns({text_col: text, removed_col: removed}).withColumn(number_col, F.size(removed_col).cast("long")).drop(rank, gone, digests, cut)
