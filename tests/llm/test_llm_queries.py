"""Every opN_ query over the smallest test tables: against its SQL, or against brute force where it has none."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from test_operators import PATH, PATTERN, stats_by_force

from graphloom.llm import bpe, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ByteBPE(PATH, PATTERN).rank, special_tokens={})
    return {d: known.encode_ordinary(t or "") for d, t in texts.items()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_quality(spark, texts):
    got = rows(spark, "op1_quality_rules")
    assert len(got) == len(texts) and {r["kept"] for r in got} == {True, False}
    for r in got:
        n, *base = stats_by_force(texts[r["doc_id"]])
        failed = n < 20 or 100 * base[3] > 30 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, *base, failed)
        assert r["kept"] == (not failed and r["rule"] == 0)


def test_decontamination(spark, texts):
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items = [(r["item_id"], r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        mine = set(bag(w))
        for i, x in items:
            his = bag(x)
            if his and len(mine & set(his)) >= 0.75 * len(his) and any((his & p).total() >= 0.75 * (his | p).total() for s in range(1 - len(x), len(w)) if (p := bag(w[max(s, 0) : s + len(x)]))):
                want.setdefault(d, set()).add(i)
    got = {r["doc_id"]: set(r["item_ids"] or ()) for r in rows(spark, "op2_decontaminate")}
    assert got.keys() == texts.keys() and want and all(got[d] >= found for d, found in want.items())
    assert {d for d, found in got.items() if found} == set(want)  # here weights of rarity add items, and no documents


def test_packing(spark, ids):
    found = {}
    for r in rows(spark, "op5_packing"):
        row, at = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_lengths"][:-1], r["cu_lengths"][1:], strict=True):
            found.setdefault(d, []).append((s, row[a:b].tolist()))
            assert at[a:b].tolist() == list(range(b - a))
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in found.items()} == {d: x for d, x in ids.items() if x}


def test_bpe(spark, texts, ids):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op8_byte_bpe")}
    assert got == {d: (len(x), sha(" ".join(map(str, x)).encode()), sha((texts[d] or "").encode())) for d, x in ids.items()}


def test_shards(spark, texts):
    got = rows(spark, "op9_shards")
    raw = {d: (t or "").encode() for d, t in texts.items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {d: (len(b) + 1, zlib.crc32(b), "rows", None) for d, b in raw.items()}
    places = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(16)}
    sizes = [len(p) for p in places.values()]
    assert len(got) == len(texts) and max(sizes) - min(sizes) <= 1 and all(p == list(range(len(p))) for p in places.values())


def test_counts(spark, ids):
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows(spark, "op10_token_counts")) == Counter((d, len(x)) for d, x in ids.items())
