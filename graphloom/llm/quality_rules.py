"""Quality rules: decision lists learned by sequential covering.

Text statistics of labelled documents are the features. Rules for low quality are grown one at a time on two thirds of the examples
still uncovered (the condition ``feature <= t`` or ``feature >= t`` of most FOIL gain is added until the rule is clean), pruned on the
other third (conditions are cut from the end while that raises (p - n) / (p + n)), and kept while they are right often enough. The
ordered list becomes one Spark conditional expression over the statistics.

Fitting reads at most ``FIT_ROWS`` labelled documents, those first in the order of a hash of their ids; the statistics and verdicts
cover every document.

Defined cases: a null text is empty and has zero statistics; a null id keeps its row and verdict; labels that are null, absent or of
one class give an empty list, which keeps all that passes the base rule; repeated rows are judged each; equal values never part a
threshold; a text of any length is one row of one task; an empty table gives no rows. Input columns named like an output
(``__base_failed``, ``__rule``, ``__kept`` and ``stats_col``) are replaced, all others stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import HashCache, freed, gram_hashes

#: Most labelled documents that a fit reads.
FIT_ROWS = 12_000
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words", "dup_line_chars"]
STATS = BASE + MORE

_TABLE = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in (
    ("space", b"\x20\t\n\x0b\x0c\r"), ("symbol", b"#*$%&|<>"), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("mark", b"!?"))}
_TABLE["start"] = (np.arange(256) & 0xC0) != 0x80  # a code point's first byte


def repeated_words(words: np.ndarray, raw: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more, the first time included."""
    if len(words) <= WINDOW:
        return 0
    grams = gram_hashes(words, WINDOW)
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    at = np.flatnonzero(twice)  # equal hashes are compared as words
    seen: dict[tuple[bytes, ...], int] = {}
    for i in at.tolist():
        key = tuple(raw[i : i + WINDOW])
        seen[key] = seen.get(key, 0) + 1
    edge = np.zeros(len(words) + 1, np.int32)
    for i in at.tolist():
        if seen[tuple(raw[i : i + WINDOW])] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: bytes, cache: HashCache) -> tuple[int, ...]:
    """``STATS`` of one UTF-8 text."""
    words = text.split()
    body = np.frombuffer(text, np.uint8)
    start = _TABLE["start"][body]
    chars = int(start.sum())
    counts = np.bincount(body, minlength=256)
    of = lambda name: int(counts[_TABLE[name]].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(lines)
    dup_chars = sum(map(len, lines)) - sum(map(len, distinct)) if len(distinct) < len(lines) else 0
    hashed = cache.of(words)
    return (len(words), chars - of("space"), of("symbol"), len(lines) - len(distinct), repeated_words(hashed, words),
            chars, len(lines), of("upper"), of("digit"), of("mark"), len(np.unique(hashed)), dup_chars)


_KIND = pa.struct([(name, pa.int64()) for name in STATS])


def stats_column(text: Column) -> Column:
    """A struct of ``STATS`` of a string column."""

    @F.arrow_udf(f"struct<{','.join(f'{name}:bigint' for name in STATS)}>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = HashCache()
        for texts in batches:
            rows = [text_stats(x.as_buffer().to_pybytes() if x.is_valid else b"", cache) for x in texts]
            columns = np.array(rows, np.int64).reshape(-1, len(STATS)).T
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_KIND))
        cache.clear()
        freed()

    return stats(text.cast("binary"))


def feature_columns(s: str) -> dict[str, Column]:
    """What conditions compare, from the struct column ``s``: the statistics and their ratios (0 for empty texts)."""
    of = lambda name: F.col(f"{s}.{name}").cast("double")
    per = lambda a, b: F.when(of(b) > 0, of(a) / of(b)).otherwise(F.lit(0.0))
    return {
        "n_words": of("n_words"), "word_length": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"), "repeat_words": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"), "marks_per_word": per("n_marks", "n_words"), "distinct_words": per("n_distinct_words", "n_words"),
        "dup_line_chars": per("dup_line_chars", "n_chars"), "words_per_line": per("n_words", "n_lines"),
    }


def base_failed(s: str) -> Column:
    """Too few words, or over 30 of 100 words repeat."""
    return (F.col(f"{s}.n_words") < 20) | (100 * F.col(f"{s}.n_repeat_words") > 30 * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature <= threshold
    threshold: float

    def column(self, features: dict[str, Column]) -> Column:
        x = features[self.feature]
        return x >= F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    support: int


class DecisionList:
    """Ordered rules for rejection; what no rule covers is kept."""

    def __init__(self, names: list[str], *, precision: float = 0.85, least: int = 8, most_conditions: int = 4, cuts: int = 48, seed: int = 7) -> None:
        self.names, self.precision, self.least, self.most_conditions, self.cuts, self.seed = names, precision, least, most_conditions, cuts, seed
        self.rules: list[Rule] = []

    def _covers(self, x: np.ndarray, conditions: list[Condition]) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for c in conditions:
            v = x[:, self.names.index(c.feature)]
            ok &= v >= c.threshold if c.above else v <= c.threshold
        return ok

    def _grow(self, x: np.ndarray, bad: np.ndarray) -> list[Condition]:
        conditions: list[Condition] = []
        inside = np.ones(len(x), bool)
        while len(conditions) < self.most_conditions and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            if not p0:
                break
            base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
            for j, name in enumerate(self.names):
                v, y = x[inside, j], bad[inside]
                order = np.argsort(v, kind="stable")
                v, y = v[order], y[order]
                ends = np.flatnonzero(np.diff(v)) + 1  # a threshold lies between different values
                if not len(ends):
                    continue
                positives = np.flatnonzero(y)
                if len(ends) > 4 * self.cuts:  # quantiles of all values and of the positives
                    wanted = np.concatenate([np.linspace(0, len(v) - 1, self.cuts), np.quantile(positives, np.linspace(0, 1, self.cuts))]).astype(int)
                    ends = np.unique(ends[np.clip(np.searchsorted(ends, wanted), 0, len(ends) - 1)])
                cum = np.concatenate([[0], np.cumsum(y)])
                for above in (False, True):
                    p = cum[-1] - cum[ends] if above else cum[ends]
                    total = len(v) - ends if above else ends
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / total) - base), -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        e = ends[k]
                        best = (gain[k], Condition(name, above, float((v[e - 1] + v[e]) / 2)))
            if best[1] is None:
                break
            conditions.append(best[1])
            inside = self._covers(x, conditions)
        return conditions

    def fit(self, x: np.ndarray, bad: np.ndarray) -> DecisionList:
        rng = np.random.default_rng(self.seed)
        left = np.ones(len(x), bool)
        while (left & bad).sum() >= self.least:
            rows = rng.permutation(np.flatnonzero(left))
            cut = len(rows) * 2 // 3
            grow, prune = rows[:cut], rows[cut:]
            conditions = self._grow(x[grow], bad[grow])
            worth = []
            for k in range(1, len(conditions) + 1):
                hit = self._covers(x[prune], conditions[:k])
                p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
                worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
            if not worth:
                break
            conditions = conditions[: -max(worth)[1]]
            hit = left & self._covers(x, conditions)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            if p < self.least or p < self.precision * (p + n):
                break
            self.rules.append(Rule(tuple(conditions), p / (p + n), p + n))
            left &= ~hit
        return self

    def column(self, features: dict[str, Column]) -> Column:
        """The number of the first rule that fits, from 1; 0 for none."""
        out: Column | None = None
        for k, rule in enumerate(self.rules, 1):
            fits = rule.conditions[0].column(features)
            for c in rule.conditions[1:]:
                fits &= c.column(features)
            out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit_rules(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options: float) -> DecisionList:
    """Learns to reject documents labelled 0. At most ``fit_rows`` ids (of known size, so the join can broadcast) and as many rows of statistics meet."""
    picked = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .where("__id is not null and __label is not null")
        .groupBy("__id").agg(F.min("__label").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    )
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")
    stats = sample.select("__id", "__label", stats_column(F.col("__text")).alias("s"))
    features = feature_columns("s")
    # A filter on the statistics would be pushed below the join, which would then compute them for every document.
    rows = stats.select("__id", "__label", base_failed("s").alias("__failed"), *[c.alias(n) for n, c in features.items()]).toArrow()
    rows = rows.filter(pc.invert(rows.column("__failed"))).drop_columns(["__failed"])
    model = DecisionList(list(features), **options)
    if not rows.num_rows:
        return model
    order = pc.sort_indices(rows, sort_keys=[("__id", "ascending"), *((n, "ascending") for n in features)])
    rows = rows.take(order)
    x = np.column_stack([rows.column(n).to_numpy() for n in features])
    return model.fit(x, rows.column("__label").to_numpy() == 0)


def judged(docs: DataFrame, model: DecisionList, *, text_col: str = "text", stats_col: str = "__stats") -> DataFrame:
    """``docs`` with the struct ``stats_col`` and the columns __base_failed, __rule (the first rule that fits, or 0) and __kept."""
    with_stats = docs.withColumn(stats_col, stats_column(F.col(text_col)))
    out = with_stats.withColumns({"__base_failed": base_failed(stats_col), "__rule": model.column(feature_columns(stats_col))})
    return out.withColumn("__kept", ~F.col("__base_failed") & (F.col("__rule") == 0))
