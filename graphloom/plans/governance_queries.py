"""Queries of governance: hotspots with their teams, and the actions that all findings ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import governance as G
from graphloom.plans import queries as Q
from graphloom.plans.queries import query
from graphloom.sources.projections import Canon

_KINDS = "kind IN ('StaticImportValue', 'StaticImportType', 'DynamicImport')"
_HOT = Q._OWNED + f"""es AS (SELECT dst AS file_id, src AS near, 1 AS i FROM edges WHERE {_KINDS} UNION ALL SELECT src, dst, 0 FROM edges WHERE {_KINDS}),
    nr AS (SELECT es.*, a.package AS p, b.package AS np, a.owner AS o, b.owner AS no FROM es JOIN owned a ON a.file_id = es.file_id JOIN owned b ON b.file_id = es.near),
    th AS (SELECT file_id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(1 - i) AS BIGINT) AS fan_out, count(*) FILTER (p <> np) AS cross_package, count(*) FILTER (o <> no) AS cross_owner, count(*) AS n,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(list(o) FILTER (o IS NOT NULL), []), coalesce(list(no) FILTER (no IS NOT NULL), [])))), ',') AS teams FROM nr GROUP BY file_id HAVING count(*) >= 5),
    hot AS (SELECT file_id, fan_in, fan_out, cross_package, cross_owner, teams, CASE WHEN cross_owner > 0 AND cross_owner > n // 3 THEN 'share-ownership' WHEN cross_package > n // 2 THEN 'extract-package'
        WHEN fan_in > 3 * fan_out AND fan_out > 0 THEN 'define-surface' WHEN fan_out > 3 * fan_in AND fan_in > 0 THEN 'split' ELSE 'review' END AS advice,
        row_number() OVER (ORDER BY n DESC, cross_owner DESC, file_id) AS rank FROM th QUALIFY rank <= 20)"""


def _hot(c: Canon) -> DataFrame:
    return G.team_hotspots(c["edges"], Q._owned(c))


@query(_HOT + " SELECT * FROM hot", ("files", "edges"))
def team_hotspots(c: Canon) -> DataFrame:
    """The twenty files with most import edges, with their teams and what to do."""
    return _hot(c).withColumns({"teams": F.array_join("teams", ","), "rank": F.col("rank").cast("long")})


_HINTS = "oh AS (SELECT a.workspace AS folder, count(*) AS edges FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst WHERE a.package <> b.package GROUP BY 1 HAVING count(*) >= 3)"
_TAGS = """tg AS (SELECT 'package' AS source FROM files GROUP BY package HAVING count(*) >= 3 UNION ALL SELECT 'workspace' FROM files GROUP BY workspace
    UNION ALL SELECT 'directory-cluster' FROM files GROUP BY regexp_extract(rel_path, '^([^/]*/[^/]*)/', 1) HAVING count(*) >= 3)"""


@query(f"""{_HOT}, {Q._COUPLED}, {_HINTS}, {_TAGS}, {Q._FENCED}, sv AS (SELECT file_id, fan_in + fan_out AS e FROM hot WHERE fan_in + fan_out >= 15),
    w AS (SELECT a.workspace AS s, b.workspace AS d FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst WHERE a.workspace <> b.workspace),
    ly AS (SELECT DISTINCT s FROM w WHERE s NOT IN (SELECT d FROM w) AND EXISTS (SELECT 1 FROM w l WHERE l.d NOT IN (SELECT s FROM w)) AND (SELECT count(DISTINCT s) FROM w) >= 3),
    ac AS (SELECT 1 AS k, 'add-boundary-rule' AS kind, 'low' AS effort, 'high' AS impact, count(*) AS items, '' AS detail FROM cp WHERE total >= 9
      UNION ALL SELECT 2, 'assign-ownership', 'medium', 'high', count(*), concat(CAST(sum(edges) AS VARCHAR), ' edges between areas') FROM oh
      UNION ALL SELECT 3, 'split-hotspot', 'high', 'high', count(*), (SELECT string_agg(concat(file_id, ' (', e, ' edges)'), ', ' ORDER BY e DESC, file_id) FROM (SELECT * FROM sv ORDER BY e DESC, file_id LIMIT 3)) FROM sv
      UNION ALL SELECT 4, 'introduce-tags', 'low', 'medium', count(*), concat(count(*) FILTER (source = 'workspace'), ' workspace, ', count(*) FILTER (source = 'package'), ' package, ', count(*) FILTER (source = 'directory-cluster'), ' directory-cluster') FROM tg
      UNION ALL SELECT 5, 'enforce-layering', 'low', 'medium', count(*), '' FROM ly UNION ALL SELECT 6, 'add-reachability-fence', 'low', 'medium', count(*), '' FROM fn)
    SELECT row_number() OVER (ORDER BY k) AS priority, kind, effort, impact, items, detail FROM ac WHERE items > 0""", ("files", "edges", "entries"))  # fmt: skip
def governance_actions(c: Canon) -> DataFrame:
    """What the coupling, owners, tags, hotspots, layers and fences found ask for, most useful first."""
    files = c["files"]
    packages, spaces = files.groupBy("package").count().where("count >= 3"), files.select("workspace").distinct()
    of = lambda rows, source: rows.select(F.lit(source).alias("source"))
    tags = of(packages, "package").unionByName(of(spaces, "workspace")).unionByName(of(G.directory_tags(files), "directory-cluster"))
    suggestions = G.forbidden_suggestions(G.package_coupling(c["edges"], files))
    found = G.governance_actions(suggestions, G.ownership_hints(c["edges"], files), tags, _hot(c), G.layers(c["edges"], files), Q.fence_packages(c))
    return found.withColumn("priority", F.col("priority").cast("long"))
