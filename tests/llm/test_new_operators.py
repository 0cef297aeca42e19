"""Toxicity, conversations and vector codes: against brute force, by accuracy, and on odd rows."""

import hashlib
import heapq
import math
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import conversations, queries, toxicity, vector_codes
from graphloom.llm.common import Workspace

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# Toxicity


def documents(spark, n=600):
    """Every fifth document has one sentence with a bad word, in inflected forms, among clean ones."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(["ba", "le", "mi", "so", "tu", "ne"], rng.integers(2, 5)))
    rows = []
    for k in range(n):
        sentences = [" ".join(word() for _ in range(rng.integers(3, 12))) for _ in range(rng.integers(2, 9))]
        bad = k % 5 == 0
        if bad:
            at = int(rng.integers(0, len(sentences)))
            sentences[at] += f" zorg{word()}"
        rows.append((k, ". ".join(sentences) + ".", int(bad), sentences[at] if bad else None))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, bad string")


def test_toxicity_finds_documents_and_sentences(spark):
    docs = documents(spark)
    model = toxicity.fit_toxicity(docs, docs)
    rows = toxicity.scored(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 80
    assert all((r["__toxicity"]["score"] >= 0.5) == bool(r["toxic"]) for r in held)
    for r in held:
        if r["toxic"]:
            spans = [r["text"][x["start"] : x["end"]].strip() for x in r["__toxicity"]["offending"]]
            assert spans == [r["bad"]]
        else:
            assert not r["__toxicity"]["offending"]


def test_toxicity_score_is_the_noisy_or_of_its_sentences():
    model = toxicity.NoisyOr({"bad": 4.0, "badl*": 1.0, "ok": -2.0}, -3.0)
    text = "Bad ok bad! Badly so\nfine...  Ok?! not bad.\n\n" + "x" * 10
    p = lambda z: 1 / (1 + math.exp(-z))
    each = [p(-3 + 4 - 2), p(-3 + 1), p(-3), p(-5), p(1), p(-3)]
    score, n, spans = model.scored_text(text, toxicity.WeightCache(model))
    assert n == len(each)
    assert score == pytest.approx(1 - math.prod(1 - x for x in each))
    assert [text[a:b].strip() for a, b, _ in spans] == ["not bad"]
    small = toxicity.WeightCache(model, most=2)
    assert model.scored_text(text, small) == (score, n, spans) and len(small) <= 2


def test_toxicity_odd_rows(spark):
    long = "bad " * 300_000
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "... !!", "c"), (2, "a bad one", "d"), (2, "a bad one", "d"), (3, long, "e")], "doc_id long, text string, __toxicity string").withColumn("__label", F.lit(9))
    model = toxicity.NoisyOr({"bad": 9.0}, -5.0)
    rows = {(r["doc_id"], r["text"] or ""): r["__toxicity"] for r in toxicity.scored(docs, model).collect()}
    assert rows[1, ""]["score"] == rows[None, ""]["score"] == rows[2, "... !!"]["score"] == 0
    assert rows[2, "a bad one"]["score"] > 0.9 and rows[3, long]["n_sentences"] == 1
    assert toxicity.scored(docs, model).count() == 6
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs.select("doc_id", "text", "__label"), labels) is not None
    empty = docs.limit(0)
    none = toxicity.fit_toxicity(empty, labels.limit(0))
    assert toxicity.scored(empty, none).count() == 0
    assert toxicity.scored(docs, none).where("__toxicity.score > 0.001").count() == 0
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 0 for d in held}


@tables
def test_toxicity_query(spark):
    rows = queries.QUERIES["op11_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert (r["n_offending"] > 0) == (r["predicted"] == 1) == (r["worst_start"] is not None)


# Conversations

COST = {"D": 3, "I": 2, "K": 0, "R": 2}


def cheapest(rows):
    """Least cost and audit of (initial, fault) rows, by a search over whole outputs; the grammar is checked on prefixes."""
    fits = re.compile(r"^(s?(ua)*u?)$")
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.match(r"^(s?(ua)+)?$", roles):
            return cost, audit
        state = (i, "s" if roles == "s" else roles[-1:])
        if state in done:
            continue
        done.add(state)
        ahead = [("I", 2, i, roles + x) for x in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            late = int(fault == "t")
            ahead.append(("D", 3, i + 1, roles))
            if fault not in ("b", "d"):
                ahead += [("K", late, i + 1, roles + initial)] + [("R", 2 + late, i + 1, roles + x) for x in "ua"]
        for name, more, j, out in ahead:
            if fits.match(out):
                heapq.heappush(heap, (cost + more, audit + name, j, out))
    raise AssertionError


def by_force(table):
    """The contract of op12 over (conv_id, turn, role, text) rows."""
    some = lambda x: " " if x is None else str(x)
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        k = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = some(role), some(text)
        own = groups[conv]
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        if k != 0:
            own += [(turn, role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        initials = [role[:1] for _, role, _ in rows]
        cost, audit = cheapest([(i or "-", f) for i, f in zip(initials, faults, strict=True)])
        lines, at, want = [], 0, ["user", "assistant"]
        for edit in audit:
            row = rows[at] if edit != "I" else None
            at += edit != "I"
            if edit == "D":
                continue
            if edit == "K":
                lines.append(f"{row[1]}:{row[2]}")
                if row[1][0] == "s":
                    continue
            else:
                lines.append(f"{want[0]}:{row[2] if row else ''}")
            want.reverse()
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, digest)
    return out


def repaired(spark, rows):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in conversations.repaired(conversations.damaged(rows)).collect()}


@tables
def test_conversations_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_conversations"](spark, SF).collect()}
    assert got == by_force(table)


def test_conversations_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    pick = lambda *x: x[rng.integers(0, len(x))]
    table = [
        (pick(None, *range(60)), pick(None, *range(9)), pick(None, "", "user", "user", "assistant", "assistant", "system", "tool", "User", "agent"), pick(None, "", " \n", "Yes.", "No", "Well?! ", "And.\t", "É…", "x" * 100_000 + ".", "same"))
        for _ in range(900)
    ]
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(7)
    extra = rows.withColumn("dropped", F.lit(True)).withColumn("Audit", F.lit("x")).withColumn("__k", F.lit(3))
    want = by_force(table)
    assert repaired(spark, extra) == want and None in want
    assert repaired(spark, rows.limit(0)) == {}


def test_conversations_without_rows_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert repaired(spark, rows) == {gone: (0, 0, 0, 0, 0, 0, "", conversations.EMPTY_SHA)}


def test_conversations_of_many_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    table = [(c, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for c in (1, 2) for t in range(500)]
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert repaired(spark, rows) == by_force(table)


def test_solving_long_signatures():
    cost, audit = conversations.solved("ua" * 20_000)
    assert (cost, audit) == (0, "K" * 40_000)
    cost, audit = conversations.solved("uxaXuA".lower() * 3_000)
    assert cost == 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R"))


# Vector codes


def codes_by_force(table):
    """The contract of op13 over (vec_id, vector, label) rows."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in table if v and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(v, least.get(i, v))
    first = [v for _, v in sorted(least.items())[:64]]
    width = len(first[0]) // 16
    x = np.array([v for _, v, _ in kept]).reshape(-1, 16, width)
    books = np.array(first).reshape(-1, 16, width).transpose(1, 0, 2).copy()

    def assigned():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(2), d.min(2)

    for _ in range(2):
        code, _ = assigned()
        for p in range(16):
            for e in range(books.shape[1]):
                if (mine := x[code[:, p] == e, p]).size:
                    books[p, e] = mine.sum(0) // len(mine)
    code, d = assigned()
    error = d.sum(1)
    total = defaultdict(int)
    for (_, _, y), e in zip(kept, error.tolist(), strict=True):
        total[y] += e
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in row), e, total[y], digest) for (i, _, y), row, e in zip(kept, code.tolist(), error.tolist(), strict=True))


def codes(spark, rows):
    space = Workspace(spark, "test")
    found, books = vector_codes.compressed(rows, space=space)
    out = vector_codes.with_label_error(found, space)
    return sorted((str(r["vec_id"]), bytes(r["code"]).hex(), r["error"], r["label_error"], books.digest() if books else None) for r in out.collect())


@tables
def test_vector_codes_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in queries.QUERIES["op13_vector_codes"](spark, SF).collect())
    assert got == codes_by_force(table)


def test_vector_codes_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, (300, 32)) / 128
    table = [(int(rng.integers(0, 200)) if k % 9 else None, v.tolist(), pick) for k, (v, pick) in enumerate(zip(vectors, rng.choice([None, 1, 2, 2, 2], 300), strict=True))]
    table += [(0, vectors[0].tolist(), None)] * 3
    odd = [(1, None, 1), (2, [], 1), (3, [float("nan")] + [0.0] * 31, 1), (4, [float("inf")] + [0.0] * 31, 2), (5, [None] + [0.0] * 31, 2)]
    rows = spark.createDataFrame([*odd, *table], "vec_id long, embedding array<float>, label int").repartition(5)
    want = codes_by_force(table)
    assert codes(spark, rows.withColumns({"code": F.lit("x"), "v": F.lit(1), "__n": F.lit(1), "Error": F.lit(0)})) == want
    assert codes(spark, rows.limit(0)) == []
    assert codes(spark, spark.createDataFrame(odd, rows.schema)) == []
    assert len(codes(spark, spark.createDataFrame([(7, [1e30] * 32, 1), (8, [0.5] * 16, 1), (9, [-1e30] * 32, 1)], rows.schema))) == 2


def test_exponion_search_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for _ in range(25):
        many, width, high = int(rng.integers(1, 20)), int(rng.integers(1, 4)), int(rng.choice([2, 4, 90]))
        entries, x = rng.integers(-high, high, (16, many, width)), rng.integers(-high, high, (120, 16 * width))
        got, d = vector_codes.Codebooks(entries).search(x, rng.integers(0, many, (120, 16)))
        every = ((x.reshape(-1, 16, 1, width) - entries[None]) ** 2).sum(-1)
        assert (got == every.argmin(2)).all() and (d == every.min(2)).all()
