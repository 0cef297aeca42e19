"""One query per operator over its whole table, and DuckDB SQL where SQL can tell the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, conversations, decontaminate, near_dedup, packing, quality_rules, sharding, stages, substring_dedup, token_counts, toxicity, url_filter, vector_codes, warc
from graphloom.llm.common import Workspace

SHARDS = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit_rules(docs, read(spark, sf_dir, "labels"))
    out = quality_rules.judged(docs, model)
    stats = [F.col(f"__stats.{c}").alias(c) for c in quality_rules.BASE]
    return out.select("doc_id", *stats, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__rule").alias("rule"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, read(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", "__leak")
    out = docs.select("doc_id").join(found, F.col("doc_id") == F.col("__leak"), "left")
    return out.select("doc_id", F.col("__leak").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item_ids", "similarity")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "warc")
    path = space.path("archives")
    warc.write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path, space=space)
    records = warc.with_revisits(warc.read_archives(spark, path, keep_payload=False, space=space), space)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(read(spark, sf_dir, "documents"), *bpe.default_vocabulary())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = substring_dedup.without_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return docs.select("doc_id", "n_removed", spans.alias("removed_spans"), "text")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_frame(read(spark, sf_dir, "documents"), *bpe.default_vocabulary(), keep_ids=False)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shuffled_shards(rows, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes flat files of the documents' ids, scans them for separators, and puts the documents' ids beside the counts."""
    space = Workspace(spark, "counts")
    flat = space.path("flat")
    token_counts.write_flat(read(spark, sf_dir, "documents"), flat, *bpe.default_vocabulary(), end_id=50_256)
    found = token_counts.document_counts(spark, flat, end_id=50_256, space=space)
    return found.select("doc_id", "n_tokens", F.col("part").alias("file_number"), "piece", F.col("at").alias("ordinal"), "start")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model)
    worst = F.reduce("__toxicity.offending", F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), F.lit(-1.0).alias("score")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return out.select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), F.col("__toxicity.score").alias("score"), (F.col("__toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("__toxicity.n_sentences").alias("n_sentences"),
        F.size("__toxicity.offending").cast("long").alias("n_offending"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repaired(conversations.damaged(rows))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "vectors")
    found, books = vector_codes.compressed(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), space=space)
    out = vector_codes.with_label_error(found, space)
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_decontaminate, op3_warc, op4_url_filter, op5_packing, op6_line_dedup, op7_near_duplicates, op8_byte_bpe, op9_shards, op10_token_counts, op11_toxicity, op12_conversations, op13_vector_codes, pipeline)
}

_TERMS = lambda terms: " + ".join(f"(CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END)" for t in terms)
#: ASCII white space.
_WS = "[\\x20\\x09-\\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS w FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
          array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
          CASE WHEN w IS NULL OR page_id = w THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN w IS NULL OR page_id = w THEN NULL ELSE w END AS refers_to
        FROM m""",
    "op4_url_filter": f"""
        WITH a AS (SELECT page_id, coalesce(url, '') AS url, {_LOWER.format("coalesce(url, '')")} AS u FROM pages),
        b AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM a),
        c AS (SELECT *, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
        v(rule, rhost, rpath, rv) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        best AS (SELECT page_id, rule, rv FROM c JOIN v ON (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)
          QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) = 1),
        h AS (SELECT c.*, {_TERMS(url_filter.STRICT)} AS strict_hits, {_TERMS(url_filter.SOFT)} AS soft_hits FROM c)
        SELECT h.page_id, host, path, rule, coalesce(rv, CASE WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
          CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_hits AS BIGINT) AS soft_hits
        FROM h LEFT JOIN best USING (page_id)""",
    "op6_line_dedup": f"""
        WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?]{_WS}+)', '\\1\ue001', 'g'), '(\\n{_WS}*)', '\\1\ue001', 'g'), '({_WS})(\\p{{Lu}})', '\\1\ue001\\2', 'g'), '\ue001') AS s FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s),
        o AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS z, trim(regexp_replace({_LOWER.format("x")}, '{_WS}+', ' ', 'g'), ' ') AS t FROM l),
        f AS (SELECT *, len(string_split(t, ' ')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(len(string_split(t, ' '))) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM o WHERE t <> ''),
        b AS (SELECT a.doc_id, a.k AS a, b.k AS b FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + {substring_dedup.UNIT_WORDS - 1} AND b.c - a.c + a.n >= {substring_dedup.UNIT_WORDS}),
        u AS (SELECT doc_id, a, min(b) AS b FROM b GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM b GROUP BY doc_id, b),
        d AS (SELECT u.doc_id, u.a, u.b, string_agg(f.t, ' ' ORDER BY f.k) AS d FROM u JOIN f ON u.doc_id = f.doc_id AND f.k BETWEEN u.a AND u.b GROUP BY u.doc_id, u.a, u.b),
        e AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(b) OVER w AS fb FROM d WINDOW w AS (PARTITION BY d ORDER BY doc_id, a, b)),
        c AS (SELECT DISTINCT f.doc_id, f.i, f.k, f.n, f.z - length(f.x) AS s, f.z FROM e JOIN f ON e.doc_id = f.doc_id AND f.k BETWEEN CASE WHEN fd = e.doc_id THEN greatest(a, fb + 1) ELSE a END AND b),
        g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c),
        r AS (SELECT doc_id, run, min(s) AS s, max(z) AS z FROM g GROUP BY doc_id, run HAVING sum(n) >= {substring_dedup.PASSAGE_WORDS}),
        m AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(s AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY s) AS removed_spans FROM r GROUP BY doc_id),
        k AS (SELECT o.doc_id, coalesce(string_agg(o.x, '' ORDER BY o.i) FILTER (x.i IS NULL), '') AS text FROM o LEFT JOIN (SELECT g.doc_id, g.i FROM g JOIN r USING (doc_id, run)) x ON o.doc_id = x.doc_id AND o.i = x.i GROUP BY o.doc_id)
        SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed_spans, '') AS removed_spans, k.text FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op7_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4]))) END AS s FROM w),
        c AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
        g AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
        p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
        e AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
        u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
        r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
        m AS (SELECT x AS rep, least(x, min(y)) AS comp FROM r GROUP BY x)
        SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(m.comp, c.rep, d.doc_id) AS component_id, d.doc_id = coalesce(m.comp, c.rep, d.doc_id) AS kept
        FROM s d LEFT JOIN c ON len(d.s) > 0 AND list_sort(d.s) = c.s LEFT JOIN m ON m.rep = c.rep""",
}
