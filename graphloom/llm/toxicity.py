"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences. A sentence's score is a logistic function of the sum of its distinct words' weights, and the document's score is
their noisy-or, 1 - prod(1 - score): one bad sentence is enough. Only documents are labelled; the gradient of the noisy-or hands a
document's label to the sentences that explain it, so the fitted model also tells which sentences offend.

A word's weight is the sum over its features: the word itself and its first ``PREFIXES`` characters (so inflected forms of a stem share
one). Features are chosen by their documents: the ``FEATURES`` that part toxic from other documents best.

The fit reads ``FIT_ROWS`` documents of either label at most, first in the order of a hash of their ids, of ``FIT_BYTES`` bytes at most
each, and weighs each label by its true share; scores cover every document and every character.

Defined cases: a null or empty text, or one without words, has no sentence and score 0; a null id is never learned from (and held out);
repeated ids give one example to the fit and one score a row; labels that are null, absent or all alike give a model that scores all 0 (or,
all toxic, what the bias says); ties in the order of features are broken by the feature; an empty table gives no rows; texts of any length
are read sentence by sentence. Other columns go along, except one named like the output column, which
is replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import freed

#: Most labelled documents of either label that a fit reads, and the most bytes of each.
FIT_ROWS = 3_000
FIT_BYTES = 32_768
FEATURES = 6_000
#: Parts in which features are counted, one after the other, for the driver's memory.
SLICES = 8
#: Least documents that a feature must be in.
LEAST = 3
PREFIXES = (4, 5, 6)
#: Characters of a sentence whose words are listed at once; longer ones are read word by word.
LONG = 1 << 20
#: Words (with apostrophes), and what parts sentences.
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
BREAK = re.compile(r"[.!?]+(?=\s|$)|\n|\Z")
KIND = "struct<score:double,n_sentences:bigint,offending:array<struct<start:bigint,end:bigint,score:double>>>"


def is_held_out(doc_id: Column) -> Column:
    """Whether an id's checksum puts it aside; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct words in lower case) of every sentence with a word."""
    at = 0
    for stop in BREAK.finditer(text):
        piece = text[at : stop.start()].lower()
        words = set(WORD.findall(piece)) if len(piece) <= LONG else {m.group() for m in WORD.finditer(piece)}
        if words:
            yield at, stop.start(), words
        at = stop.end()


class Bags:
    """Examples of a fit: numbers of the words of all sentences in a row, where sentences and documents start, and labels."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.words, self.sentences, self.documents, self.labels = array("i"), array("l"), array("l"), array("l")

    def add(self, text: str, label: int) -> None:
        first, number = len(self.sentences), self.number
        for _, _, words in sentences(text):
            self.sentences.append(len(self.words))
            self.words.extend([number.setdefault(w, len(number)) for w in sorted(words)])
        if len(self.sentences) > first:
            self.documents.append(first)
            self.labels.append(label)


class NoisyOr:
    """Weights of features and a bias; see the module's text."""

    def __init__(self, weights: dict[str, float] | None = None, bias: float = -40.0) -> None:
        self.weights, self.bias = weights or {}, bias

    def word_weight(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word))

    def fit(self, bags: Bags, shares: tuple[float, float], *, rounds: int = 150, rate: float = 0.15, decay: float = 0.2) -> NoisyOr:
        """Adam over all examples; ``shares`` are the weights of an example labelled 0 and 1."""
        labels = np.array(bags.labels, np.int64)
        if not len(labels) or not labels.any():
            return self
        number, ids = bags.number, np.array(bags.words, np.int32)
        starts = np.array(bags.sentences)
        sentence = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(ids)))
        document = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(np.array(bags.documents), append=len(starts)))
        chosen = self._chosen(number, ids, document[sentence], labels)
        at = {f: k for k, f in enumerate(chosen)}
        pairs = [(w, at[f]) for word, w in number.items() for f in word_features(word) if f in at]
        pairs.sort()
        of_word = np.array([p[0] for p in pairs], np.int64)
        of_feature = np.array([p[1] for p in pairs], np.int64)
        first, last = np.searchsorted(of_word, np.arange(len(number))), np.searchsorted(of_word, np.arange(len(number)), side="right")
        used = np.flatnonzero((last > first)[ids])  # words without a feature add nothing
        many = (last - first)[ids[used]]
        rows = np.repeat(sentence[used], many)
        columns = of_feature[_runs(first[ids[used]], many)].astype(np.int32)
        share = np.where(labels == 1, shares[1], shares[0]) / (shares[0] * (labels == 0).sum() + shares[1] * labels.sum())
        w, b, m, v = np.zeros(len(chosen)), -5.0, np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        for t in range(1, rounds + 1):
            z = np.bincount(rows, w[columns], len(starts)) + b
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -60, 60))), 1e-15, 1 - 1e-12)
            none = np.bincount(document, np.log1p(-p), len(labels))  # logarithm of "no sentence offends"
            some = -np.expm1(none)
            pull = np.where(labels == 1, -np.exp(none) / np.maximum(some, 1e-12), 1.0) * share
            g = pull[document] * p
            slope = np.append(np.bincount(columns, g[rows], len(chosen)) + decay * w * share.mean(), g.sum())
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
            w, b = w - step[:-1], b - step[-1]
        self.weights, self.bias = {f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, float(b)
        return self

    @staticmethod
    def _chosen(number: dict[str, int], ids: np.ndarray, document: np.ndarray, labels: np.ndarray) -> list[str]:
        """The features whose presence tells most about the label (two-by-two G statistic)."""
        both = np.unique(ids.astype(np.int64) * len(labels) + document)
        names: dict[str, int] = {}
        flat, many = array("i"), np.zeros(len(number), np.int32)
        for k, word in enumerate(number):
            own = [names.setdefault(f, len(names)) for f in word_features(word)]
            flat.extend(own)
            many[k] = len(own)
        word, document = (both // len(labels)).astype(np.int32), (both % len(labels)).astype(np.int32)
        start = np.cumsum(many) - many
        feature, doc = np.array(flat, np.int32)[_runs(start[word], many[word])], np.repeat(document, many[word])
        docs, bad = np.zeros(len(names)), np.zeros(len(names))
        for part in range(SLICES):  # pairs of a feature and a document count once
            mine = feature % SLICES == part
            pairs = np.unique(feature[mine].astype(np.int64) * len(labels) + doc[mine])
            docs += np.bincount(pairs // len(labels), minlength=len(names))
            bad += np.bincount(pairs // len(labels), labels[pairs % len(labels)], len(names))
        clean, toxic = float((labels == 0).sum()), float(labels.sum())
        worth = np.zeros(len(names))
        for here, there, total in ((docs - bad, docs, clean), (bad, docs, toxic), (clean - docs + bad, len(labels) - docs, clean), (toxic - bad, len(labels) - docs, toxic)):
            expected = there * total / len(labels)
            worth += 2 * np.where(here > 0, here * np.log(np.maximum(here, 1e-300) / np.maximum(expected, 1e-300)), 0)
        order = sorted(((-worth[k], f) for f, k in names.items() if docs[k] >= LEAST))
        return [f for _, f in order[:FEATURES]]

    def scored_text(self, text: str, cache: WeightCache, least: float = 0.5) -> tuple[float, int, list[tuple[int, int, float]]]:
        """(score, sentences, offending) of a text.

        ``offending`` has (start, end, score) in code points of the sentences that score ``least`` or more, of a document that does; if no
        sentence does so by itself, the worst one.
        """
        none, count, out, worst, of = 0.0, 0, [], None, cache.__getitem__
        for start, end, words in sentences(text):
            z = self.bias + math.fsum(map(of, words))
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            none += math.log1p(-min(p, 1 - 1e-12))
            count += 1
            if p >= least:
                out.append((start, end, p))
            elif worst is None or p > worst[2]:
                worst = (start, end, p)
        score = -math.expm1(none)
        return score, count, (out or [worst]) if count and score >= least else []


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, ``many`` of them, all in a row."""
    ends = np.cumsum(many, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + many, many)


class WeightCache(dict):
    """Word to its weight; emptied when it holds ``most`` words."""

    def __init__(self, model: NoisyOr, most: int = 200_000) -> None:
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        value = self.model.word_weight(word)
        if len(word) <= 64:
            self[word] = value
        return value


def toxicity_column(text: Column, model: NoisyOr, *, least: float = 0.5) -> Column:
    """A struct of ``KIND``: the document's score, its sentences, and where those that offend stand (of documents that score ``least`` or more)."""

    @F.arrow_udf(KIND)
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WeightCache(model)
        for texts in batches:
            rows = []
            for x in texts:
                body = x.as_py() or ""
                score, count, spans = model.scored_text(body, cache, least)
                rows.append({"score": score, "n_sentences": count, "offending": [dict(zip(("start", "end", "score"), s, strict=True)) for s in spans]})
            yield pa.array(rows, pa.struct([("score", pa.float64()), ("n_sentences", pa.int64()), ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]))
        cache.clear()
        freed()

    return scores(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> NoisyOr:
    """Learns from labelled documents that aren't held out; at most ``2 * fit_rows`` ids meet the documents, so the join can broadcast them."""
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .where("__id is not null and __label in (0, 1)").where(~is_held_out(F.col("__id")))
        .groupBy("__id").agg(F.max("__label").alias("__label"))
    )
    totals = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    first = lambda y: known.where(F.col("__label") == y).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.octet_length("__text") <= fit_bytes)
    rows = sample.join(F.broadcast(first(0).unionByName(first(1))), "__id").groupBy("__id").agg(F.min("__label").alias("__label"), F.min("__text").alias("__text"))
    table = rows.select("__id", "__label", "__text").toArrow().sort_by("__id")
    bags = Bags()
    got = Counter()
    for label, text in zip(table.column("__label"), table.column("__text"), strict=True):
        bags.add(text.as_py(), label.as_py())
        got[label.as_py()] += 1
    del table
    shares = tuple(totals.get(y, 0) / got[y] if got[y] else 1.0 for y in (0, 1))
    return NoisyOr().fit(bags, shares)


def scored(docs: DataFrame, model: NoisyOr, *, text_col: str = "text", out_col: str = "__toxicity", least: float = 0.5) -> DataFrame:
    """``docs`` with the struct ``out_col`` (see ``KIND``)."""
    return docs.withColumn(out_col, toxicity_column(F.col(text_col), model, least=least))
