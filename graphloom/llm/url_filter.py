"""URL filters: a weighted vocabulary found by an Aho-Corasick automaton, and host and path rules.

One pass over each URL counts the strict and soft terms in it, A-Z lower-cased. A hit counts only between boundaries: the characters
beside it are neither letters nor digits of ASCII. One strict term rejects, as do several distinct soft ones.

Rules of a host and a path prefix come before the vocabulary: a rule fits its host and all its subdomains where the URL's path starts
with the rule's; the longest wins, of equally long ones the first in the alphabet.

The vocabulary is two lists of terms, or a table of terms and weights (``vocabulary``): terms of weight ``STRICT_WEIGHT`` or more are strict.
It goes to every task, so its size is checked (``MOST_TERMS``).

Defined cases: a null URL or one without ``://`` has an empty host and path; a null URL has no hits and is allowed; repeated rows are
judged each; a null id stays null; an empty URL is judged like one without ``://``; a URL of any length is searched whole in one pass; empty terms
are left out, a term in both lists is strict; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that reject by themselves, and terms that reject together.
STRICT = ("adult", "casino", "escort", "porn", "xxx")
SOFT = ("bet", "bets", "bonus", "cheap", "free", "hot", "jackpot", "loan", "nude", "pills", "poker", "sexy", "slots", "win")
SOFT_HITS = 2
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Weight from which a term is strict; most terms of a vocabulary.
STRICT_WEIGHT, MOST_TERMS = 1.0, 1_000_000

_LOWER = {c: c + 32 for c in range(65, 91)}
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def vocabulary(terms: DataFrame, *, term_col: str = "term", weight_col: str = "weight") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The strict and the soft terms of a table, A-Z lower-cased, by their greatest weight; terms of no or no positive weight are left out."""
    lower = F.translate(term_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = terms.select(lower.alias("term"), F.col(weight_col).cast("double").alias("weight")).where("term <> '' and weight > 0")
    rows = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    strict = sorted(r["term"] for r in rows if r["weight"] >= STRICT_WEIGHT)
    return tuple(strict), tuple(sorted(r["term"] for r in rows if r["weight"] < STRICT_WEIGHT))


@functools.lru_cache(maxsize=2)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for terms, weight in ((soft, 1), (strict, 2)):
        for term in filter(None, terms):
            found.add_word(term.translate(_LOWER), (term.translate(_LOWER), weight))
    found.make_automaton()
    return found


def term_hits(found: ahocorasick.Automaton, url: str) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms between boundaries, in a lower-cased URL."""
    strict: set[str] = set()
    soft: set[str] = set()
    if not len(found):
        return strict, soft
    for end, (term, weight) in found.iter(url):
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in _INSIDE) and (end + 1 == len(url) or url[end + 1] not in _INSIDE):
            (strict if weight == 2 else soft).add(term)
    return strict, soft


def host_and_path(url: str | None) -> tuple[str, str]:
    _, cut, rest = (url or "").partition("://")
    if not cut:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class RuleSet:
    """Rules by host; a URL looks up its host and each parent domain, so the number of rules doesn't slow it."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
            host, cut, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((cut + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        while host:
            for prefix, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix):
                    if best is None or (-len(rule), rule) < (-len(best[0]), best[0]):
                        best = rule, verdict
                    break
            host = host.partition(".")[2]
        return best


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, strict_hits, soft_hits). One pass over the URL column, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ruled = automaton(strict, soft), RuleSet(rules)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                hard, weak = term_hits(found, (url or "").translate(_LOWER))
                rule = ruled.find(host, path)
                own = "block" if hard or len(weak) >= soft_hits else "allow"
                rows.append((host, path, rule[0] if rule else None, rule[1] if rule else own, len(hard), len(weak)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            out = [batch.column(0), *(pa.array(c, pa.string()) for c in columns[:4]), *(pa.array(c, pa.int64()) for c in columns[4:])]
            yield pa.RecordBatch.from_arrays(out, ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    schema = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long"
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, schema)
