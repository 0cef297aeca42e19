"""Queries of paths, chains and expectations: origins of re-exported names, lookup by suffix, links, folders that changed, findings against what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import chains, expectations, paths
from graphloom.plans.queries import query
from graphloom.sources.projections import Canon


@query("""l AS (SELECT reexporter AS f, exported AS n, min(struct_pack(f := source, n := original)) AS t FROM reexports WHERE exported <> '*' GROUP BY 1, 2),
    w(f, n, t, seen) AS (SELECT f, n, t, [struct_pack(f := f, n := n)] FROM l
      UNION ALL SELECT w.f, w.n, l.t, list_append(w.seen, w.t) FROM w JOIN l ON l.f = w.t.f AND l.n = w.t.n WHERE NOT list_contains(w.seen, w.t)),
    z AS (SELECT w.f AS file, w.n AS name, w.t, len(seen) AS hops, list_contains(seen, w.t) AS cyclic, list_sort(seen[list_position(seen, w.t):])[1] AS least FROM w LEFT JOIN l ON l.f = w.t.f AND l.n = w.t.n WHERE l.f IS NULL OR list_contains(seen, w.t))
    SELECT file, name, CASE WHEN cyclic THEN least.f ELSE t.f END AS origin, CASE WHEN cyclic THEN least.n ELSE t.n END AS original, CASE WHEN NOT cyclic THEN hops END AS hops, cyclic FROM z""", ("edges", "reexports"))  # fmt: skip
def export_origins(c: Canon) -> DataFrame:
    """Where every re-exported name is declared, however many files pass it on."""
    return chains.export_origins(c["reexports"])


_ASKED = "CASE WHEN file_id % 5 = 0 THEN rel_path WHEN file_id % 17 = 0 THEN concat('no/', rel_path) ELSE right(rel_path, CAST(3 + file_id * 7 % 37 AS INT)) END"


@query(f"""q AS (SELECT DISTINCT {_ASKED} AS query FROM files)
    SELECT query, CASE WHEN count(*) FILTER (f.rel_path = query) > 0 THEN query ELSE min(f.rel_path) END AS rel_path FROM q LEFT JOIN files f ON ends_with(f.rel_path, query) GROUP BY query""", ("files",))  # fmt: skip
def suffix_files(c: Canon) -> DataFrame:
    """The file that each name of a file means: every fifth is whole, every seventeenth wrong, the others are ends of 3 to 39 characters."""
    return paths.suffix_lookup(c["files"].select(F.expr(_ASKED).alias("query")), c["files"])


# Links of packages by their number's last digit: through another package's link, straight, up from where a link led, to each other, out of the repository; the rest are none.
_LINKED = """k AS (SELECT DISTINCT package, CAST(regexp_extract(package, '([0-9]+)$', 1) AS INT) AS n FROM files),
    lk AS (SELECT package, n, concat('by/', package) AS path, CASE n % 6 WHEN 0 THEN concat('../real/', package) WHEN 1 THEN concat('./brand-', n - 1, '/../up') WHEN 2 THEN concat('brand-', n + 1) WHEN 3 THEN concat('brand-', n - 1) WHEN 4 THEN concat('../../', package) END AS target FROM k)"""


@query(_LINKED + """, asked AS (SELECT package, concat('by/', package, '/f', file_id, '.ts') AS path, file_id FROM files)
    SELECT path, CASE n % 6 WHEN 0 THEN concat('real/', a.package, '/f', file_id, '.ts') WHEN 1 THEN concat(CASE WHEN EXISTS (SELECT 1 FROM k o WHERE o.n = k.n - 1) THEN 'real/up' ELSE 'by/up' END, '/f', file_id, '.ts')
        WHEN 2 THEN CASE WHEN NOT EXISTS (SELECT 1 FROM k o WHERE o.n = k.n + 1) THEN concat('by/brand-', k.n + 1, '/f', file_id, '.ts') END
        WHEN 3 THEN CASE WHEN NOT EXISTS (SELECT 1 FROM k o WHERE o.n = k.n - 1) THEN concat('by/brand-', k.n - 1, '/f', file_id, '.ts') END WHEN 4 THEN NULL ELSE path END AS canonical,
      CASE n % 6 WHEN 4 THEN 'outside' WHEN 5 THEN 'plain' WHEN 2 THEN CASE WHEN EXISTS (SELECT 1 FROM k o WHERE o.n = k.n + 1) THEN 'loop' ELSE 'linked' END
        WHEN 3 THEN CASE WHEN EXISTS (SELECT 1 FROM k o WHERE o.n = k.n - 1) THEN 'loop' ELSE 'linked' END ELSE 'linked' END AS outcome FROM asked a JOIN k ON k.package = a.package""", ("files",))  # fmt: skip
def canonical_paths(c: Canon) -> DataFrame:
    """Every file by way of its package's link: where that leads."""
    number = F.regexp_extract("package", r"(\d+)$", 1).cast("int")
    brand = lambda by: F.concat(F.lit("brand-"), (F.col("n") + by).cast("string"))
    way = F.col("n") % 6
    to = (
        F.when(way == 0, F.concat(F.lit("../real/"), "package")).when(way == 1, F.concat(F.lit("./"), brand(-1), F.lit("/../up")))
        .when(way == 2, brand(1)).when(way == 3, brand(-1)).when(way == 4, F.concat(F.lit("../../"), "package"))
    )
    links = c["files"].select("package", number.alias("n")).distinct().select(F.concat(F.lit("by/"), "package").alias("path"), to.alias("target"))
    return paths.canonical_paths(c["files"].select(F.format_string("by/%s/f%d.ts", "package", "file_id").alias("path")), links)


_BEFORE = "SELECT rel_path, CAST(p_size AS VARCHAR) AS digest FROM files"
_AFTER = """SELECT CASE WHEN file_id % 701 = 0 THEN concat(rel_path, '/more/deep.ts') ELSE rel_path END AS rel_path, CAST(CASE WHEN file_id % 401 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS digest FROM files WHERE file_id % 577 <> 0"""
_SUMS = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


def _levels(deepest: int) -> str:
    """Folders of both snapshots, level by level from the deepest."""
    up = "array_to_string(string_split(folder, '/')[:-2], '/')"
    sql = f"fs AS (SELECT 'a' AS v, rel_path, digest FROM ({_BEFORE}) UNION ALL SELECT 'b', rel_path, digest FROM ({_AFTER})), ff AS (SELECT v, array_to_string(string_split(rel_path, '/')[:-2], '/') AS folder, len(string_split(rel_path, '/')) - 1 AS depth, sha256(concat('f/', string_split(rel_path, '/')[-1], '/', digest)) AS h FROM fs), "
    for d in range(deepest, -1, -1):
        below = f" UNION ALL SELECT v, {up}, sha256(concat('d/', string_split(folder, '/')[-1], '/', digest)) FROM g{d + 1}" if d < deepest else ""
        sql += f"g{d} AS (SELECT v, folder, sha256(concat_ws(',', {_SUMS}, CAST(count(*) AS VARCHAR))) AS digest FROM (SELECT v, folder, h FROM ff WHERE depth = {d}{below}) GROUP BY v, folder), "
    return sql + "ga AS (" + " UNION ALL ".join(f"SELECT * FROM g{d}" for d in range(deepest + 1)) + ")"


@query(_levels(6) + """ SELECT coalesce(a.folder, b.folder) AS folder, CASE WHEN a.folder IS NULL THEN 'added' WHEN b.folder IS NULL THEN 'removed' ELSE 'changed' END AS change, a.digest AS digest_before, b.digest AS digest_after
    FROM (SELECT * FROM ga WHERE v = 'a') a FULL JOIN (SELECT * FROM ga WHERE v = 'b') b ON a.folder = b.folder WHERE a.digest IS DISTINCT FROM b.digest""", ("files",))  # fmt: skip
def folder_changes(c: Canon) -> DataFrame:
    """Folders that differ after some files have changed, gone, and become folders."""
    sql = lambda text: c.spark.sql(text.replace("AS VARCHAR", "AS STRING").replace("FROM files", "FROM {files}"), files=c["files"])
    return paths.changed_folders(sql(_BEFORE), sql(_AFTER))


_FOUND = "SELECT workspace AS case, 'unused-file' AS code, rel_path AS subject FROM files WHERE file_id % 3 <> 0 UNION ALL SELECT workspace, 'unused-file', rel_path FROM files WHERE file_id % 10 = 0"
_WANTED = """SELECT workspace AS case, 'unused-file' AS code, rel_path AS subject FROM files WHERE file_id % 4 = 0 UNION ALL SELECT workspace, 'unused-file', rel_path FROM files WHERE file_id % 20 = 0
    UNION ALL SELECT workspace, 'unused-file', concat(workspace, '/src/', package, '/*') FROM files WHERE file_id % 3 = 1 UNION ALL SELECT workspace, 'unused-file', '*' FROM files WHERE file_id % 5 = 0"""


@query(f"""fo AS (SELECT "case", subject, count(*) AS n FROM ({_FOUND.replace(" case,", ' "case",')}) GROUP BY ALL), ex AS (SELECT "case", subject, count(*) AS n FROM ({_WANTED.replace(" case,", ' "case",')}) GROUP BY ALL),
    e1 AS (SELECT coalesce(fo."case", ex."case") AS c, coalesce(fo.subject, ex.subject) AS s, coalesce(fo.n, 0) AS f, coalesce(ex.n, 0) AS e, least(f, e) AS met
      FROM fo FULL JOIN (SELECT * FROM ex WHERE NOT contains(subject, '*')) ex ON fo."case" = ex."case" AND fo.subject = ex.subject),
    l1 AS (SELECT c, regexp_replace(s, '/[^/]*$', '') AS d, sum(f - met) AS f FROM e1 GROUP BY ALL),
    e2 AS (SELECT coalesce(c, "case") AS c, coalesce(f, 0) AS f, coalesce(n, 0) AS e, least(coalesce(f, 0), coalesce(n, 0)) AS met FROM l1 FULL JOIN (SELECT "case", left(subject, -2) AS folder, n FROM ex WHERE ends_with(subject, '/*')) w ON c = "case" AND d = folder),
    l2 AS (SELECT c, sum(f - met) AS f FROM e2 GROUP BY c), e3 AS (SELECT c, f, coalesce(n, 0) AS e, least(f, coalesce(n, 0)) AS met FROM l2 LEFT JOIN (SELECT * FROM ex WHERE subject = '*') a ON c = "case"),
    t AS (SELECT c, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(met) AS BIGINT) AS met FROM (SELECT c, e, met FROM e1 UNION ALL SELECT c, e, met FROM e2 UNION ALL SELECT c, e, met FROM e3) GROUP BY c),
    x AS (SELECT c, CAST(f - met AS BIGINT) AS extra FROM e3)
    SELECT t.c AS family, expected, met, expected - met AS missed, extra, round(100 * (0.7::DOUBLE * CASE WHEN expected > 0 THEN met / expected ELSE 1 END + 0.3::DOUBLE * CASE WHEN met + extra > 0 THEN met / (met + extra) ELSE 1 END), 4) AS score FROM t JOIN x ON x.c = t.c""", ("files",))  # fmt: skip
def expected_findings(c: Canon) -> DataFrame:
    """Findings against expectations of each workspace: some twice, some for a folder, some for anything."""
    rows = lambda text: c.spark.sql(text.replace("FROM files", "FROM {files}"), files=c["files"])
    return expectations.case_scores(*expectations.matched(rows(_WANTED), rows(_FOUND))).withColumnRenamed("case", "family")


@query("""m AS (SELECT family, tool, CASE count(*) % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'partial' ELSE 'unsupported' END AS level, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) > 0.8 AS passed FROM parity GROUP BY family, tool)
    SELECT family, upper(replace(tool, '-', '.')) AS name, level, passed, CASE WHEN level = 'supported' THEN NOT passed ELSE passed END AS stale FROM m""", ("parity",))  # fmt: skip
def stale_claims(c: Canon) -> DataFrame:
    """What is claimed of each tool's cases in a family against what they do; results write the tools' names their own way."""
    share = F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)) > 0.8
    cases = c["parity"].groupBy("family", F.col("tool").alias("name")).agg((F.count("*") % 3).alias("k"), share.alias("passed"))
    level = F.when(F.col("k") == 0, "supported").when(F.col("k") == 1, "partial").otherwise("unsupported")
    return expectations.stale_claims(cases.select("family", "name", level.alias("level")), cases.select("family", F.upper(F.translate("name", "-", ".")).alias("name"), "passed"))
