"""Benchmark decontamination by exact shingle lookup, with DataFrame functions only.

A document holds an item if some window of it, as long as the item (shorter at the document's ends), has a similarity of ``percent``
hundredths or more: the greater of plain and weighted Jaccard similarity of the shingles (runs of five words) with multiplicity. Weights are
of rarity: one by the number of different item texts that hold a shingle; one for what the item doesn't hold.

Every shingle of every document is looked up in the items' shingles. Any similarity over zero needs a shared shingle, so no candidate is
lost, whatever was changed between. What meets is a place (document, item, position, shingle); no text is shuffled. Places are put together
by document and item; where all of them would not do for the threshold, the pair goes. For the others the windows that begin at a shared shingle, and
those from the document's start that end with one, are compared: a window that begins otherwise can be moved on to the next shared
shingle without loss, as it only drops words that the item doesn't hold, so the best window is among them.

The documents are read once. An index of ``INDEX_ROWS`` rows at most (of known width) is broadcast to them; for a larger one the documents' shingles are
shuffled to it by their hash.

Words are runs without ASCII white space, lower-cased. Items of fewer than 5 words have no shingle and match nothing.
Defined cases: null and empty texts have no shingles; null ids of items count as one item of a null id (counted in n_items, not listed in item_ids); documents with null or
repeated ids are each kept or dropped by their id's hits, null ids by none; empty tables work; further columns go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NEAR_PERCENT, SHINGLE_WORDS, Workspace, unused_name

#: Most rows of an index that is broadcast; one takes about 100 bytes.
INDEX_ROWS = 400_000
_WHITE = "[\\x20\\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    """The words of a text, lower-cased."""
    body = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(body) > 0, F.split(body, _WHITE)).otherwise(F.array().cast("array<string>"))


def with_shingles(rows: DataFrame, words: str) -> DataFrame:
    """``rows`` with ``at`` and ``g`` in place of ``words``: one row for every run of five words, with its place (from 0) and hash."""
    n = SHINGLE_WORDS
    out = rows.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w))).drop(words)
    run = ", ".join(["x", *(f"__h[i + {k}]" for k in range(1, n))])
    out = out.withColumn("__g", F.expr(f"if(size(__h) < {n}, array(), transform(slice(__h, 1, size(__h) - {n - 1}), (x, i) -> xxhash64({run})))")).drop("__h")
    # Not explode: it would add a filter on the array's size, which goes below the steps that make the array and repeats them.
    return out.select("*", F.posexplode_outer("__g").alias("at", "g")).drop("__g").where("g is not null")


def item_index(items: DataFrame, *, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (item, item_id), each text having its own key ``item``, and rows (item, g, weight, times, n, n_words, total): each text's distinct shingles.

    ``times`` is how often the item has the shingle, ``n`` the number of its shingles, ``total`` their weight.
    """
    base = items.select(F.col(id_col).cast("long").alias("item_id"), word_array(F.col(text_col)).alias("words")).where(F.size("words") >= SHINGLE_WORDS)
    base = base.withColumn("item", F.xxhash64("words")).withColumn("n_words", F.size("words"))
    each = with_shingles(base.select("item", "n_words", "words").dropDuplicates(["item"]), "words").groupBy("item", "n_words", "g").agg(F.count("*").cast("int").alias("times"))
    rarity = each.groupBy("g").agg((1.0 / F.count("*")).alias("weight"))
    each = each.join(rarity, "g")
    sums = each.groupBy("item").agg(F.sum("times").cast("int").alias("n"), F.round(F.sum(F.col("weight") * F.col("times")), 9).alias("total"))
    return base.select("item", "item_id").distinct(), each.join(sums, "item").select("item", "g", "weight", "times", "n", "n_words", "total")


def similarities(places: DataFrame, percent: int) -> DataFrame:
    """Rows (doc_id, item, similarity) of the pairs that reach ``percent``, from rows (doc_id, text, n_doc, at) and the index's columns, one per shared shingle.

    A shared shingle counts for a window's intersection if the one ``times`` before it in the document lies before the window: so it counts as
    often as both sides have it.
    """
    pair = ["doc_id", "text", "n_doc", "item", "n", "n_words", "total"]
    each = places.groupBy(*pair, "g", "weight", "times").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    both = F.least(F.size("ats"), F.col("times"))
    found = F.expr("transform(ats, (a, i) -> named_struct('at', a, 'before', if(i >= times, ats[i - times], -1), 'w', weight))")
    pairs = each.groupBy(*pair).agg(F.sum(both).alias("most"), F.sum(both * F.col("weight")).alias("heaviest"), F.array_sort(F.flatten(F.collect_list(found))).alias("f"))
    # No window shares more than the whole document, and none can be less than the intersection.
    pairs = pairs.where((100 * F.col("most") >= percent * F.col("n")) | (100 * F.col("heaviest") >= percent * F.col("total") - 1e-6))
    n = SHINGLE_WORDS - 1
    # A window: its first shingle, its number of shingles, and the shared ones in it.
    starts = f"transform(f, (x, i) -> named_struct('s', x.at, 'n', least(n, n_doc - {n} - x.at), 'f', filter(slice(f, i + 1, n), y -> y.at < x.at + n)))"
    ends = "transform(filter(slice(f, 1, n), x -> x.at < n - 1), (x, i) -> named_struct('s', 0, 'n', x.at + 1, 'f', slice(f, 1, i + 1)))"
    shared = "aggregate(v.f, named_struct('k', 0, 'both', 0D, 'own', 0D), (a, y) -> named_struct('k', a.k + if(y.before < v.s, 1, 0), 'both', a.both + if(y.before < v.s, y.w, 0D), 'own', a.own + y.w))"
    window = f"transform(concat({starts}, {ends}), v -> named_struct('t', {shared}, 'n', v.n, 'other', v.n - size(v.f)))"
    best = f"array_max(transform({window}, x -> greatest(x.t.k / (x.n + n - x.t.k), x.t.both / (x.t.own + x.other + total - x.t.both))))"
    return pairs.select("doc_id", "item", F.round(F.expr(best), 6).alias("similarity")).where(100 * F.col("similarity") >= percent)


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", percent: int = NEAR_PERCENT, space: Workspace | None = None) -> DataFrame:
    """Rows (doc_id, item_id, similarity): the best alignment of each item in each document."""
    space = space or Workspace(docs.sparkSession, "leaks")
    ids, index = item_index(items, id_col=item_id_col, text_col=item_text_col)
    ids, index = space.table(ids, "items"), space.table(index, "index")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text"), word_array(F.col(text_col)).alias("words")).where("doc_id is not null")
    grams = with_shingles(texts.withColumn("n_doc", F.size("words")), "words")
    found = grams.join(F.broadcast(index) if index.count() <= INDEX_ROWS else index.hint("merge"), "g")
    close = similarities(space.table(found, "places"), percent).join(ids, "item")
    return close.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None, **options: str) -> DataFrame:
    """Rows (doc_id, n_items, item_ids, similarity) of the documents that hold an item."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, space=space, **options)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))


def without_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None) -> DataFrame:
    """``docs`` less the documents that hold an item; null ids stay."""
    name = unused_name(docs, "leak")
    space = space or Workspace(docs.sparkSession, "leaks")
    found = space.table(leaks(docs, items, id_col=id_col, text_col=text_col, space=space).select(F.col("doc_id").alias(name)), "leaks")
    return docs.join(found.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(name), "left_anti")
