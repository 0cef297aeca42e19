"""Each operator against a brute-force version, with nulls, empties, ties, repeated rows, empty tables and clashing columns."""

import base64
import os
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, near_dedup, packing, quality_rules, sharding, substring_dedup, token_counts, url_filter, warc
from graphloom.llm.common import HashCache, Workspace

PATH, PATTERN = bpe.default_vocabulary()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hi string, rep string, __k int"


def docs(spark, texts):
    """Rows of texts or (id, text), with columns whose names the operators use inside."""
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in rows], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


ODD = ["", None, " \n\t ", "one", "a  b\n\n c", "É " * 30, "x" * 5000, "don't stop's 12 ###\n" * 12]


def test_bpe(spark):
    own = bpe.ByteBPE(PATH, PATTERN)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.rank, special_tokens={})
    texts = [*ODD, "<|endoftext|> ⁇unknown \x00 日本", " ".join(words(3000, 1)), "tab\there  two\n\nthree "]
    got = bpe.encode_frame(docs(spark, texts), PATH, PATTERN).orderBy("doc_id").collect()
    assert [own.ids(r["ids"]) for r in got] == [reference.encode_ordinary(t or "") for t in texts]
    back = bpe.decode_frame(bpe.encode_frame(docs(spark, texts), PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").collect()
    assert [bytes(r["text"]).decode() for r in back] == [t or "" for t in texts]
    assert bpe.encode_frame(docs(spark, []), PATH, PATTERN).count() == 0
    again = docs(spark, [(1, "same words here"), (1, "same words here"), (None, "same words here"), (2, " ".join(words(300_000, 5))), (3, "x" * 300_000)]).withColumns({"ids": F.lit("clash"), "n_tokens": F.lit("clash")})
    assert Counter((r["doc_id"], own.ids(r["ids"]) == reference.encode_ordinary("same words here")) for r in bpe.encode_frame(again, PATH, PATTERN).collect()) == {(1, True): 2, (None, True): 1, (2, False): 1, (3, False): 1}


def test_bpe_of_odd_texts():
    """Texts of all kinds of white space and marks, with a cache that is emptied between calls."""
    own = bpe.ByteBPE(PATH, PATTERN, most_bytes=2000)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.rank, special_tokens={})
    rng = random.Random(7)
    marks = "ab'sé \n\t  .,1２你\u00a0\u2028\u3000ñ’'re\ue000ÿ\x85\x1c\u200b"
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 24))) for _ in range(4000)] + [p.decode(errors="ignore") for p in own.pieces[::9]]
    texts += [" ".join(words(50, k)) for k in range(200)] + ["\x85a b", "a\u00a0 b", "a b\u3000", None]
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        assert [own.ids(x) for x in own.encode_many(part)] == [reference.encode_ordinary(t or "") for t in part]


def test_bpe_of_pieces_that_merging_does_not_reach(tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"xyz": 258}
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(p).decode()} {r}" for p, r in ranks.items()))
    own = bpe.ByteBPE(str(tmp_path / "v"), PATTERN)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert own.unmerged == {"xyz": 258}
    for t in ("xyz", "xyz abc ab  xyz", "\nxyz, xyz", "wxyz"):
        assert own.ids(own.encode(t)) == reference.encode_ordinary(t)


def stats_by_force(text):
    w = (text or "").encode().split()
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality(spark):
    loop = " ".join(words(11, 2))
    texts = [*ODD, f"{loop} {loop} tail", " ".join(["w"] * 40), *(" ".join(words(60, s)) for s in range(60)), *(" ".join(x + "###" for x in words(60, s)) for s in range(60))]
    for t in texts:
        assert quality_rules.text_stats((t or "").encode(), HashCache())[:5] == stats_by_force(t)
    table = docs(spark, texts)
    n = len(ODD) + 2
    labels = spark.createDataFrame([(i, int(i < n + 60)) for i in range(n, n + 120)] + [(None, 1), (n, None)], "doc_id long, quality int")
    model = quality_rules.fit_rules(table, labels)
    assert model.rules
    out = {r["doc_id"]: r for r in quality_rules.judged(table, model).collect()}
    assert all(out[i]["__kept"] for i in range(n, n + 60)) and not any(out[i]["__kept"] for i in range(n + 60, n + 120))
    assert not out[1]["__kept"] and out[1]["__stats"]["n_words"] == 0 and out[0]["hi"] == "x"
    assert not quality_rules.fit_rules(table, labels.limit(0)).rules
    assert quality_rules.judged(docs(spark, []), model).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.org/es/1?x", "https://x.org", None, "nothing", "http://x.com/fr/casino", "http://free-bets.net/", "http://freebets.net/", "http://casino.net", "http://a.net/free/free", "http://example.org/en/12", "http://example.org/en/2#a", "http://x.com/de/"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(table).orderBy("page_id").collect()]
    assert got == [("a.example.org", "/es/1", "example.org/es/", "block"), ("x.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.com", "/fr/casino", "com/fr/", "allow"), ("free-bets.net", "/", None, "block"), ("freebets.net", "/", None, "allow"), ("casino.net", "", None, "block"), ("a.net", "/free/free", None, "allow"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("x.com", "/de/", "com/de/", "block")]
    assert url_filter.judge_urls(table.limit(0)).count() == 0


def test_url_vocabulary(spark):
    terms = [("Casino", 1.0), ("bet", 0.4), ("BET", 0.2), ("", 9.0), ("no", 0.0), (None, 1.0), ("x", None), *((f"term{k}", 0.1 + (k % 7 == 0)) for k in range(5000))]
    strict, soft = url_filter.vocabulary(spark.createDataFrame(terms, "term string, weight double"))
    assert len(strict) + len(soft) == 5002 and "casino" in strict and "bet" in soft and "term7" in strict and "term8" in soft
    urls = [f"http://a.net/{'/'.join(random.Random(k).choices(['term7', 'term8', 'xterm7', 'bet', 'term9', 'ok', 'casino7'], k=3))}" for k in range(200)] + ["", "http://a.net/" + "term8-" * 300_000, "http://a.net/bet", "http://a.net/bet"]
    table = spark.createDataFrame([(None if k % 50 == 49 else k // 2, u) for k, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit("clash"), "Verdict": F.lit("clash")})
    got = Counter((r["page_id"], r["strict_hits"], r["soft_hits"], r["verdict"]) for r in url_filter.judge_urls(table, strict=strict, soft=soft).collect())
    want = Counter()
    for k, u in enumerate(urls):
        parts = set(re.split("[^a-z0-9]+", u))
        hard, weak = len(parts & set(strict)), len(parts & set(soft))
        want[None if k % 50 == 49 else k // 2, hard, weak, "block" if hard or weak >= 2 else "allow"] += 1
    assert got == want


def test_warc(spark):
    big = "".join(chr(97 + i % 26) for i in range(5000)) + "WARC/1.1\r\n\r\n"
    rows = [(0, "u0", "same"), (3, "u 3", "same"), (3, "u3", "same"), (5, None, ""), (6, "u", None), (7, "u", big), (8, "u", big + "!"), (None, "u", "same"), (None, "u", "alone")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    space = Workspace(spark, "test")
    path = space.path("archives")
    warc.write_archives(table, path, segment=700)
    got = warc.with_revisits(warc.read_archives(spark, path, space=space)).collect()
    key = lambda r: (r["page_id"] is not None, r["page_id"] or 0, r["payload_digest"])
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((j for j, _, x in rows if (x or "") == (h or "") and j is not None), default=None)
        revisit = top is not None and i != top
        expected.append((i, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", top if revisit else None))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == sorted(expected, key=str)
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {"same", "", big, big + "!", "alone"}
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((i, u or "") for i, u, _ in rows)
    path = space.path("archives")
    warc.write_archives(table.limit(0), path)
    assert warc.with_revisits(warc.read_archives(spark, path)).count() == 0
    long = "".join(words(1_000_000, 3))
    odd = [(1, " \t\r\nu: é\x00 ", "p"), (2, "http://x/" + "y" * 9000, long), (3, "z" * (5 << 20), long), *((100 + k, "u", "") for k in range(600))]
    path = space.path("archives")
    warc.write_archives(spark.createDataFrame(odd, "page_id long, url string, html string"), path)
    got = {r["page_id"]: r for r in warc.with_revisits(warc.read_archives(spark, path, keep_payload=False)).collect()}
    assert got[1]["url"] == odd[0][1] and got[2]["url"] == odd[1][1] and got[3]["url"].startswith("urn:sha1:") and got[2]["payload_bytes"] == len(long) == got[3]["payload_bytes"]
    assert len(got) == 603 and got[2]["refers_to"] == 3 and [i for i, r in got.items() if r["payload_bytes"] == 0 and r["record_type"] == "response"] == [699]
    big_archive = b"".join(warc.member(warc.record([("WARC-Type", "x")], b"y" * 1500)) for _ in range(20_000))
    began = time.perf_counter()
    assert sum(len(r) > 1500 for r in warc.members_of(big_archive)) == 20_000 and time.perf_counter() - began < 5
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert key


def test_packing(spark):
    texts = [*ODD, *(" ".join(words(n, n)) for n in (5, 40, 700, 90, 12, 300, 300))]
    own = bpe.ByteBPE(PATH, PATTERN)
    rows = packing.packed_rows(docs(spark, texts).repartition(2), PATH, PATTERN, row_tokens=64).collect()
    found = {}
    for r in rows:
        ids, at = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == len(at) == 64 and r["cu_lengths"][-1] == r["n_tokens"] <= 64 and (ids[r["n_tokens"] :] == 50256).all()
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_lengths"][:-1], r["cu_lengths"][1:], strict=True):
            found.setdefault(d, []).append((s, ids[a:b].tolist()))
            assert at[a:b].tolist() == list(range(b - a))
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in found.items()} == {i: own.ids(own.encode(t)) for i, t in enumerate(texts) if t}
    rng = random.Random(5)
    lengths = np.array([rng.randint(0, 150) for _ in range(400)])
    pieces = sorted((p for n in lengths.tolist() for p in [*[64] * (n // 64), n % 64] if p), reverse=True)
    free = []
    for p in pieces:  # plain best fit
        fits = [k for k, f in enumerate(free) if f >= p]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= p
        else:
            free.append(64 - p)
    assert Counter(64 - sum(n for _, _, n in r) for r in packing.best_fit(lengths, 64)) == Counter(free)
    assert packing.packed_rows(docs(spark, []), PATH, PATTERN).count() == 0


def test_matrices(spark):
    texts = [*ODD, "w " * 100_000, *(" ".join(words(n, n)) for n in (5, 40, 700, 90, 12, 300, 300)), "same text", "same text"]
    table = docs(spark, [*enumerate(texts), (2, "same text"), (None, "no id")]).withColumns({"shard": F.lit("clash"), "ids": F.lit("clash")})
    path = Workspace(spark, "test").path("matrices")
    packed = Workspace(spark, "test").table(packing.packed_rows(table.repartition(3), PATH, PATTERN, row_tokens=64), "packed")
    packing.write_matrices(packed, path, end_id=50256)
    back = packing.read_matrices(spark, path, row_tokens=64).select(packed.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, packed.collect())) and packed.count() > 900
    flat = [f for f in os.listdir(f"{path.removeprefix('file://')}/ids/shard=0") if f.endswith(".txt")]
    raw = np.fromfile(f"{path.removeprefix('file://')}/ids/shard=0/{flat[0]}", "<u2").reshape(-1, 65)
    assert len(flat) == 1 and (raw[:, 64] == 50256).all() and raw[3, :64].tobytes() == bytes(packed.where("shard = 0 and row = 3").first()["ids"])


def fragments_by_force(text):
    """Fragments that have words, looked at character by character."""
    white = " \t\n\x0b\x0c\r"
    out, start, k = [], 0, 0
    while k < len(text):
        end = k
        while end < len(text) and text[end] in white:
            end += 1
        if end > k and ("\n" in text[k:end] or (k and text[k - 1] in ".!?") or (end < len(text) and unicodedata.category(text[end]) == "Lu")):
            out.append((start, end))
            start = end
        k = max(end, k + 1)
    return [(a, b, w) for a, b in [*out, (start, len(text))] if (w := text[a:b].encode().lower().split())]


def passages_by_force(rows, least=8, together=40):
    """{place in rows: (text, spans)} of (id, text) rows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, out = {}, {}
    for i in order:
        text = rows[i][1]
        found = fragments_by_force(text or "")
        units = {(a, min(b for b in range(a, len(found)) if sum(len(f[2]) for f in found[a : b + 1]) >= least)) for a in range(len(found)) if sum(len(f[2]) for f in found[a:]) >= least}
        units |= {(max(a for a in range(b + 1) if sum(len(f[2]) for f in found[a : b + 1]) >= least), b) for b in range(len(found)) if sum(len(f[2]) for f in found[: b + 1]) >= least}
        gone = set()
        for a, b in sorted(units):
            j, end = first.setdefault(b" ".join(w for f in found[a : b + 1] for w in f[2]), (i, b))
            gone |= set(range(a if j != i else max(a, end + 1), b + 1))
        spans, k = [], 0
        while k < len(found):
            end = k
            while end in gone:
                end += 1
            if sum(len(f[2]) for f in found[k:end]) >= together:
                spans.append((found[k][0], found[end - 1][1]))
            k = end + 1
        out[i] = (text and "".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)])), spans)
    return out


def prose(n, seed):
    """Sentences of ``n`` words together."""
    rng, w, out = random.Random(seed), words(n, seed), []
    while w:
        k = rng.randint(1, 12)
        out.append(" ".join(w[:k]).capitalize() + rng.choice([". ", ".\n", ".  ", "! "]))
        w = w[k:]
    return "".join(out).strip()


def test_passages(spark):
    p, q, r = prose(60, 1), prose(45, 2), prose(30, 3)
    verse = "\n".join(" ".join(words(3, s)) for s in range(20))
    tail = prose(25, 9)
    rows = [
        (4, f"here is {p} and so on"), (2, f"In {prose(30, 4)} the middle of\n{p} something else. {q}"), (9, f"{q}\nown end"), (7, None), (8, ""), (5, f"x y {r} z {tail}"), (6, f"a b {r} c"),
        (10, f"List\n{verse}\nend"), (11, f"{verse}\nother"), (12, f"{q} and {q} and {q}"), (13, p.replace(" ", "   ")), (14, p.swapcase()), (16, "É É É. " * 90), (17, "é\tñ\n" * 60),
        *((20 + i, f"{words(1, i)[0]} own {i} {prose(50, 77)} {i} {prose(20, 200 + i)}") for i in range(300)), (600, " ".join(prose(40, s) for s in range(300, 360))), (601, prose(41, 333)), (602, f"{'x' * 3_000_000} {q}"),
    ]
    table = docs(spark, rows).withColumns({"removed": F.lit("clash"), "N_removed": F.lit("clash"), "__rank": F.lit(5), "first": F.lit("kept")})
    want = passages_by_force(rows)
    out = {x["doc_id"]: x for x in substring_dedup.without_copies(table).collect()}
    assert {i: (x["text"], [tuple(y) for y in x["removed"]], x["n_removed"]) for i, x in out.items()} == {rows[k][0]: (t, s, len(s)) for k, (t, s) in want.items()}
    assert out[4]["text"] == "here is and so on" and out[11]["text"] == "other" and out[5]["n_removed"] == out[6]["n_removed"] == 0 and out[9]["text"] == "own end"
    assert sum(x["n_removed"] > 0 for x in out.values()) > 300 and out[4]["first"] == "kept" and out[4]["__rank"] == 5
    assert substring_dedup.without_copies(docs(spark, [])).count() == 0


def test_passages_of_rows_without_an_own_id(spark):
    p, q = prose(50, 1), prose(50, 2)
    rows = [(None, p), (None, f"{q} x"), (3, f"a {p}"), (3, f"b {p}"), (None, q), ((1 << 63) - 1, f"last {q}"), (5, q), (5, q)]
    out = [(x["doc_id"], x["text"]) for x in substring_dedup.without_copies(docs(spark, rows)).collect()]
    assert len(out) == 8 and sum(p in t for _, t in out) == 1 and sum(q in t for _, t in out) == 1
    assert [t for i, t in out if i == 5 and t] == [q] and {t for i, t in out if i == 3} in ({f"a {p}", "b "}, {"a ", f"b {p}"})
    assert sorted(t for i, t in out if i is None) == ["", "", "x"] and [t for i, t in out if i == (1 << 63) - 1] == ["last "]


def near_by_force(rows):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {k: rows[k][0] for k in sets}
    changed = True
    while changed:
        changed = False
        for x in sets:
            for y in sets:
                both = len(sets[x] & sets[y])
                if rows[x][0] is not None and rows[y][0] is not None and (rows[x][0] == rows[y][0] and sets[x] and sets[y] or both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both)) and label[x] > label[y]:
                    label[x] = label[y]
                    changed = True
    return sorted((str(i), len(sets[k]), str(label[k])) for k, (i, _) in enumerate(rows))


def test_near(spark, monkeypatch):
    rng = random.Random(3)
    base = words(120, 7)
    rows = [(10, " ".join(base)), (11, " ".join(base)), (12, None), (13, ""), (14, "few words"), (15, "FEW words"), (None, " ".join(base))]
    for k in range(60):  # copies of one text, each changed at its own places: most are linked with it only
        copy = list(base)
        for p in rng.sample(range(120), rng.choice([1, 2, 3])):
            copy[p] = f"new{k}x{p}"
        rows.append((20 + k, " ".join(copy)))
    rows += [(200 + k, " ".join(words(80, 100 + k))) for k in range(10)]
    want = near_by_force(rows)
    for block in (256, 16):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = near_dedup.near_duplicates(docs(spark, rows)).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_remaining(spark, monkeypatch):
    base = words(160, 7)
    rows = []
    for k in range(12):  # chains: each next text changes further words, so that its ends aren't linked with each other
        chain = list(base)
        for step in range(6):
            for p in range(step * 20 + k % 3, step * 20 + 12, 6):
                chain[p] = f"w{k}x{p}"
            rows.append((10 * k + step, " ".join(chain)))
    want = near_by_force(rows)
    space = Workspace(spark, "test")
    texts = docs(spark, rows).select("doc_id", F.col("text").cast("binary").alias("text"))
    reps = space.table(near_dedup.signed(texts, 5), "signed").select(F.col("doc_id").alias("rep"), "sig", F.col("n_shingles").alias("n"))
    near = space.table(near_dedup.region_rows(near_dedup.tree_rows(reps), 24 * len(rows)), "regions")
    sets = spark.createDataFrame([(i, near_dedup.shingle_set(HashCache().of(t.encode().split())).tobytes()) for i, t in rows], "rep long, set binary")
    monkeypatch.setattr(near_dedup, "BLOCK", 1)  # every region is a large one, and every tile small
    for tile, dense in ((1, 1 << 14), (3, 1 << 14), (2, 40)):
        monkeypatch.setattr(near_dedup, "TILE", tile)
        monkeypatch.setattr(near_dedup, "DENSE", dense)
        links = near_dedup.links_of(near_dedup.remaining(near.withColumn("comp", F.col("rep")), sets, 75, space), sets, 75)
        comp = {r["rep"]: r["comp"] for r in near_dedup.components(links, space).collect()}
        assert sorted((str(i), n, str(comp.get(int(i), int(i)))) for i, n, _ in want) == want
    assert near_dedup.remaining(near.withColumn("comp", F.lit(1).cast("long")), sets, 75, space).count() == 0


def test_recall(spark):
    """Pairs from the least similarity on, alone in their regions: those found against exact pairs."""
    rows = []
    for k in range(400):
        one = words(200, 5000 + k)
        two = list(one)
        for p in range(10, 10 + 28 * (k % 6), 28):
            two[p] = "changed"
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    rows.append((9999, " ".join(words(400_000, 3))))
    want = near_by_force(rows)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_dedup.near_duplicates(docs(spark, rows)).collect())
    linked = {i for i, _, c in want if i != c}
    assert len(linked) > 250 and {i for i, _, c in got if i != c} <= linked
    assert sum(x in got for x in want if x[0] in linked) >= 0.99 * len(linked)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 100), (95, 100)], "a long, b long")
    got = {r["rep"]: r["comp"] for r in near_dedup.components(links, Workspace(spark, "test")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_leaks(spark):
    items = [(0, " ".join(words(30, 1))), (1, " ".join(words(50, 2))), (2, "too short"), (3, None), (4, " ".join(words(12, 3)))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    one, two, three = items[0][1], items[1][1].split(), items[4][1]
    cut = " ".join(two[:20] + ["CHANGED"] + two[21:])
    texts = [*ODD, f"{' '.join(words(33, 9))} {one.upper()} {' '.join(words(40, 8))}", f"a\n{cut}", " ".join(two[:25]), " ".join(words(500, 6)), (None, one), (50, one), (50, one), three, "x " + three + " y"]
    table = docs(spark, [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.hits(table, bench).collect()}
    n = len(ODD)
    assert got == {(n, 0), (n + 1, 1), (50, 0), (n + 7, 4), (n + 8, 4)}
    left = {r["doc_id"] for r in decontaminate.without_leaks(table, bench).collect()}
    assert left == {*range(n), n + 2, n + 3, None}
    assert decontaminate.hits(docs(spark, []), bench).count() == 0 and decontaminate.hits(table, bench.limit(0)).count() == 0


def test_shards(spark):
    rows = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("c").alias("clash")).unionByName(spark.createDataFrame([(None, "n"), (5, "again")], "doc_id long, clash string")).repartition(7)
    out = sharding.shuffled_shards(rows, 16).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == 1005 and counts.max() - counts.min() <= 1 and len(counts) == 16
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    large = [10**10, 3, 0, 7 * 10**9 + 1, 10**11]
    matrix = sharding.communication_matrix(large, 16, 3)
    assert matrix.sum(axis=1).tolist() == large and np.ptp(matrix.sum(axis=0)) <= 1 and matrix.min() >= 0
    assert np.abs(matrix[0] - 10**10 / 16).max() < 6 * (10**10 / 16) ** 0.5
    matrix = sharding.communication_matrix([10, 0, 500, 495], 16, 3)
    assert matrix.sum(axis=1).tolist() == [10, 0, 500, 495] and set(matrix.sum(axis=0)) <= {62, 63}
    assert sharding.shuffled_shards(rows.limit(0), 16).count() == 0


def test_hypergeometric_draws_have_their_law():
    rng = np.random.default_rng(11)
    for good, bad, n in ((40, 60, 30), (40, 60, 75), (5, 200, 100), (300, 20, 40), (3, 4, 7), (0, 9, 4), (9, 0, 30 - 22), (1000, 1000, 900)):
        got = np.bincount([sharding.hypergeometric(rng, good, bad, n) for _ in range(6000)], minlength=n + 1)
        want = np.bincount(np.random.default_rng(12).hypergeometric(good, bad, n, 200_000), minlength=n + 1) / 200_000 * 6000
        some = want > 5
        assert got[want == 0].sum() <= 6
        assert ((got - want)[some] ** 2 / want[some]).sum() < some.sum() + 5 * (2 * some.sum()) ** 0.5 + 5


def test_shards_of_clashing_columns(spark):
    table = docs(spark, [*((k, t) for k, t in enumerate(ODD)), (1, "again"), (1, "again"), (None, None)]).withColumns({"shard": F.lit("x"), "Slot": F.lit("y"), "__row": F.lit(1), "__part": F.lit(2), "__at": F.lit(3), "__cell": F.lit(4), "__upto": F.lit(5), "__start": F.lit(6)})
    out = sharding.shuffled_shards(table.repartition(4), 3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in table.collect())
    assert Counter(r["shard"] for r in out) in (Counter({0: 4, 1: 4, 2: 3}), Counter({0: 4, 1: 3, 2: 4}), Counter({0: 3, 1: 4, 2: 4}))
    assert all((r["__row"], r["__part"], r["__at"], r["__cell"], r["__upto"], r["__start"]) == (1, 2, 3, 4, 5, 6) for r in out)


def test_shards_are_uniform(spark):
    """Every row is as likely in every shard and every place: over many seeds, chi-squared stays near its degrees of freedom."""
    counts, seeds, shards = [7, 0, 30, 13], 4000, 4
    sent = sum(sharding.communication_matrix(counts, shards, s) for s in range(seeds))
    want = np.outer(counts, [1 / shards] * shards) * seeds
    assert np.abs(sent - want).max() < 5 * np.sqrt(want.max())
    first = np.zeros((20, shards))
    rows = spark.range(20, numPartitions=3)
    for s in range(12):
        for r in sharding.shuffled_shards(rows, shards, seed=s).collect():
            first[r["id"], r["shard"]] += 1
    assert (first.sum(axis=0) == 12 * 5).all() and first.max() <= 10


def test_counts(spark):
    texts = [*ODD, *(" ".join(words(n, n)) for n in (5, 400, 90))]
    own = bpe.ByteBPE(PATH, PATTERN)
    space = Workspace(spark, "test")
    path = space.path("flat")
    table = docs(spark, texts).coalesce(1)
    token_counts.write_flat(table, path, PATH, PATTERN, end_id=50256)
    want = [len(own.ids(own.encode(t))) for t in texts]
    for block in (1, 7, 64, 1 << 20):
        got = token_counts.scan_files(spark, f"{path}/kind={token_counts.TOKENS}", end_id=50256, block=block).orderBy("ordinal").collect()
        assert [r["n_tokens"] for r in got] == want and all(r["complete"] for r in got)
        assert [r["start"] for r in got] == [sum(want[:k]) + k for k in range(len(want))]
    with pytest.raises(Exception, match="separator"):
        token_counts.write_flat(table, space.path("flat"), PATH, PATTERN, end_id=5)


def test_counts_beside_ids(spark, monkeypatch):
    whole = token_counts.slices
    monkeypatch.setattr(token_counts, "FILE_BYTES", 100)
    monkeypatch.setattr(token_counts, "slices", lambda batch, column: whole(batch, column, 50))
    texts = [*ODD, "w " * 200_000, *(" ".join(words(n, n)) for n in (5, 400, 90))]
    rows = [*enumerate(texts), (3, texts[3]), (3, "another text"), (None, "no id"), (None, None)]
    own = bpe.ByteBPE(PATH, PATTERN)
    want = Counter((i, len(own.ids(own.encode(t)))) for i, t in rows)
    table = docs(spark, rows).withColumns({"value": F.lit("clash"), "at": F.lit("clash"), "kind": F.lit("clash")})
    for end in (50256, 70000):
        path = Workspace(spark, "test").path("flat")
        token_counts.write_flat(table.repartition(3), path, PATH, PATTERN, end_id=end)
        found = token_counts.document_counts(spark, path, end_id=end).collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == want
        assert max(r["piece"] for r in found) >= 1
    path = Workspace(spark, "test").path("flat")
    token_counts.write_flat(docs(spark, []).coalesce(1), path, PATH, PATTERN, end_id=50256)
    assert token_counts.document_counts(spark, path, end_id=50256).collect() == []


def test_file_numbers(spark):
    """A written file's name holds a random part, which can look like a number itself."""
    names = [f"file:/x/part-7/kind=0/piece={k}/part-0000{k}-c{k}4e-c05a-4f.c00{k}.txt" for k in range(3)]
    got = token_counts._numbered(spark.createDataFrame([(n,) for n in names], "file string"), "file").orderBy("part").collect()
    assert [(r["part"], r["piece"]) for r in got] == [(0, 0), (1, 1), (2, 2)]


def test_scan_of_foreign_files(spark, tmp_path):
    for name, ids in (("a", []), ("b", [50256, 1, 50256, 2, 3]), ("c", [50256])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = {(r["file"][-1], r["ordinal"], r["start"], r["n_tokens"], r["complete"]) for r in token_counts.scan_files(spark, f"file://{tmp_path}", end_id=50256, block=2).collect()}
    assert got == {("b", 0, 0, 0, True), ("b", 1, 1, 1, True), ("b", 2, 3, 2, False), ("c", 0, 0, 0, True)}
    (tmp_path / "d").write_bytes(b"\x01")
    with pytest.raises(Exception, match="inside an id"):
        token_counts.scan_files(spark, f"file://{tmp_path}", end_id=50256).collect()


def test_leaks_of_items_without_an_id_of_their_own(spark):
    texts = [" ".join(words(40, k)) for k in range(20, 25)]
    bench = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (8, texts[4]), (8, texts[4])], "item_id long, text string")
    table = docs(spark, [f"{' '.join(words(30, 90 + k))} {t} z" for k, t in enumerate(texts)])
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontaminate.hits(table, bench).collect()}
    assert got == {(0, 7, 1.0), (1, 7, 1.0), (2, None, 1.0), (3, None, 1.0), (4, 8, 1.0)}
    found = {r["doc_id"]: (r["n_items"], r["item_ids"]) for r in decontaminate.leaks(table, bench).collect()}
    assert found == {0: (1, [7]), 1: (1, [7]), 2: (1, []), 3: (1, []), 4: (1, [8])}
    assert decontaminate.without_leaks(table, bench).count() == 0


def leaks_by_force(rows, items):
    """The best similarity of each item to any window of its length, of all those that reach 0.75; items' shingles are their own."""
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = {}
    for i, t in rows:
        w = t.lower().split()
        for k, x in items:
            x = x.lower().split()
            mine = bag(x)
            for s in range(1 - len(x), len(w)):
                part = bag(w[max(s, 0) : s + len(x)])
                both, either = (mine & part).total(), (mine | part).total()
                if either and both / either >= 0.75:
                    out[i, k] = max(out.get((i, k), 0), round(both / either, 6))
    return out


def test_leaks_by_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, " ".join(words(n, 200 + k))) for k, n in enumerate((7, 16, 60, 100, 200, 400))]
    items.append((6, " ".join([*words(8, 300), *words(8, 300), *words(8, 301)])))
    rows = []
    for k, x in items:
        for changes in range(13):
            w = x.split()
            for c in range(changes):  # spread over the item, so that hardly a long run is left
                at = (2 * c + 1) * len(w) // (2 * changes)
                w[at : at + 1] = [["NEW"], [], ["NEW", w[at]]][rng.randrange(3)]
            rows.append((len(rows), " ".join([*words(rng.randint(0, 9), len(rows)), *w[rng.choice((0, 0, len(w) // 10)) :], *words(rng.randint(0, 9), 900 + len(rows))])))
    for k, changes in [(3, 2), (4, 3), (5, 10), *[(4, 5)] * 12]:
        w = items[k][1].split()
        for c in range(changes):
            w[(2 * c + 1) * len(w) // (2 * changes) + rng.randint(-5, 5)] = f"NEW{rng.random()}"
        rows.append((len(rows), " ".join([*words(7, k), *w, *words(9, changes)])))
    want = leaks_by_force(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (400_000, 0):  # the index broadcast, and shuffled
        monkeypatch.setattr(decontaminate, "INDEX_ROWS", most)
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.hits(docs(spark, rows), bench).collect()}
        assert len(want) > 20 and got == pytest.approx(want)


def test_leaks_of_shared_item_texts(spark):
    one, frame = words(50, 400), words(40, 401)
    items = [*((k, " ".join(one)) for k in range(4)), *((k, " ".join([*frame, *words(10, 402 + k)])) for k in range(4, 8))]
    changed = " ".join([*one[:25], "NEW", *one[26:]])
    other = " ".join([*frame[:20], "NEW", *frame[21:], *words(10, 406)])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.hits(docs(spark, [changed, other]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {**{(0, k): round(41 / 51, 6) for k in range(4)}, (1, 4): round(41 / 51, 6)}
