"""Matching of expectations against a largest matching found by force; claims that results contradict."""

import random
from collections import Counter

from graphloom.operators import expectations


def fits(expected, found):
    (c, k, s), (c2, k2, s2) = expected, found
    return (c, k) == (c2, k2) and (s == s2 or s == "*" or (s.endswith("/*") and s2.startswith(s[:-1])))


def largest(expected, found):
    """How many of ``expected`` can be met, by augmenting paths; ``found`` is used once each."""
    by = {}

    def place(i, seen):
        for j, f in enumerate(found):
            if j not in seen and fits(expected[i], f):
                seen.add(j)
                if j not in by or place(by[j], seen):
                    by[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(expected)))


def test_as_many_as_can_be_are_met(spark):
    rng = random.Random(12)
    path = lambda: "/".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    key = lambda: (rng.choice(["one", "two"]), rng.choice(["unused-file", "cycle"]))
    found = [(*key(), path()) for _ in range(60)] + [("two", "only-found", "x")] * 2
    expected = [(*key(), path() + rng.choice(["", "", "/*"])) for _ in range(70)] + [(*key(), "*") for _ in range(4)] + [("three", "cycle", "a/*")] * 2
    frame = lambda rows: spark.createDataFrame(rows, "case string, code string, subject string")
    met, extras = expectations.matched(frame(expected), frame(found))
    rows = met.collect()
    assert {(r["case"], r["code"], r["subject"]): r["expected"] for r in rows} == Counter(expected) and all(r["met"] + r["missed"] == r["expected"] and r["met"] >= 0 for r in rows)
    for keys in {e[:2] for e in expected + found}:
        mine = [e for e in expected if e[:2] == keys], [f for f in found if f[:2] == keys]
        n = sum(r["met"] for r in rows if (r["case"], r["code"]) == keys)
        assert n == largest(*mine)
        assert [(r["found"], r["extra"]) for r in extras.collect() if (r["case"], r["code"]) == keys] == ([(len(mine[1]), len(mine[1]) - n)] if mine[1] else [])
    scores = {r["case"]: r for r in expectations.case_scores(met, extras).collect()}
    assert scores["three"]["score"] == 30.0 and scores["three"]["missed"] == 2 and sum(r["extra"] for r in scores.values()) == len(found) - sum(r["met"] for r in rows)


def test_nothing_and_nulls(spark):
    frame = lambda rows: spark.createDataFrame(rows, "case string, code string, subject string")
    met, extras = expectations.matched(frame([]), frame([]))
    assert met.count() == 0 and extras.count() == 0
    met, extras = expectations.matched(frame([("a", None, None), ("a", "c", "*")]), frame([("a", None, None), ("a", "c", None), ("a", "c", "x")]))
    assert {tuple(r) for r in met.collect()} == {("a", "", "", 1, 1, 0), ("a", "c", "*", 1, 1, 0)} and {tuple(r) for r in extras.collect()} == {("a", "", 1, 0), ("a", "c", 2, 1)}


def test_stale_claims(spark):
    claims = spark.createDataFrame([("f", "Glob imports", "supported"), ("f", "glob-imports", "partial"), ("f", "vue.sfc", "partial"), ("g", "x", "supported")], "family string, name string, level string")
    results = spark.createDataFrame([("f", "glob-imports", True), ("f", "GLOB.imports", False), ("f", "vue-sfc", True), ("g", "x", False), ("g", "unknown", True)], "family string, name string, passed boolean")
    got = {(r["family"], r["name"]): (r["level"], r["stale"]) for r in expectations.stale_claims(claims, results).collect()}
    assert got == {("f", "glob-imports"): ("partial", True), ("f", "GLOB.imports"): ("supported", True), ("f", "vue-sfc"): ("partial", True), ("g", "x"): ("supported", True)}
