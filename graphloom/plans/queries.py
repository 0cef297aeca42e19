"""Queries over the canonical tables, and the SQL that says the same."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.operators import analyzers as A
from graphloom.operators import governance as G
from graphloom.operators import fixes, graph, liveness, manifests, report, resolve, rules, tags
from graphloom.operators.tables import Rounds
from graphloom.sources.projections import Canon, with_tables
from graphloom.streaming.watch import invalidation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, tables: tuple[str, ...] = ()) -> Callable:
    """Registers a function of the canonical tables under its name; ``oracle`` may use the tables named."""

    def put(f: Callable[[Canon], DataFrame]) -> Callable[[Canon], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Canon(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = f"WITH RECURSIVE {with_tables(*tables)}, {oracle.lstrip()}" if tables and oracle.lstrip()[0] != "S" else f"WITH RECURSIVE {with_tables(*tables)} {oracle}" if tables else oracle
        return f

    return put


def _roles(path: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({path}, '{p}') THEN '{label}'" for p, label in C.ROLES) + " ELSE 'source' END"


_SEEDS = "seeds AS (SELECT file_id AS n FROM entries), "
_REACH = _SEEDS + "r(n) AS (SELECT n FROM seeds UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.n), "
_ROLED = f"roled AS (SELECT *, {_roles('rel_path')} AS role, regexp_replace(rel_path, '/[^/]*$', '') AS directory FROM files), "


def roled_files(c: Canon) -> DataFrame:
    # Roles are told by many expressions, and a table of few bytes a row is read by few tasks.
    return c["files"].repartition("file_id").withColumn("role", C.file_role(F.col("rel_path"))).withColumn("directory", F.regexp_replace("rel_path", r"/[^/]*$", ""))


def seeds(c: Canon, profiles: tuple[str, ...] = ("production", "development", "both")) -> DataFrame:
    return c["entries"].where(F.col("profile").isin(*profiles)).select(F.col("file_id").alias("node"))


@query(_REACH.rstrip(", ") + " SELECT n AS node FROM r", ("edges", "entries"))
def reachable_parts(c: Canon) -> DataFrame:
    return graph.reach(c["edges"], seeds(c)).select("node")


def _written(c: Canon, name: str) -> DataFrame:
    """A table that is read several times, also by tables made of it later: it is computed once and written."""
    c.made[name] = Rounds(c.spark).table(c[name])
    return c.made[name]


def _unused(role_filter: str, profile: str) -> str:
    return (
        f"seeds AS (SELECT file_id AS n FROM entries WHERE profile IN ({profile})), r(n) AS (SELECT n FROM seeds UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.n), " + _ROLED + """
        total AS (SELECT CAST(sum(unresolved) AS BIGINT) * 100 // CAST(sum(unresolved) + sum(resolved) AS BIGINT) AS pct FROM pressure),
        b AS (SELECT f.*, coalesce(p.unresolved, 0) AS own FROM roled f LEFT JOIN pressure p USING (file_id)),
        nb AS (SELECT *, CAST(sum(own) OVER (PARTITION BY directory) AS BIGINT) - own AS neighbour FROM b)
        SELECT substr(sha256(concat_ws('|', 'unused-file', rel_path, '')), 1, 16) AS id, 'unused-file' AS code, 'warn' AS severity,
          CASE WHEN own >= 5 OR pct > 15 OR neighbour >= 8 THEN 'low' WHEN file_id NOT IN (SELECT dst FROM edges) AND own = 0 AND (pct > 5 OR neighbour >= 3) THEN 'medium'
            WHEN file_id NOT IN (SELECT dst FROM edges) AND own = 0 THEN 'high' ELSE 'medium' END AS confidence,
          rel_path AS subject, CAST(NULL AS VARCHAR) AS rule_name
        FROM nb CROSS JOIN total WHERE role NOT IN ('fixture', 'example', 'template', 'benchmark', 'config', 'generated', 'buildOutput') """ + role_filter + """
          AND NOT regexp_matches(rel_path, '\\.d\\.[mc]?ts$') AND file_id NOT IN (SELECT n FROM r)""")  # fmt: skip


_UNUSED_TABLES = ("files", "edges", "entries", "pressure")


@query(_unused("", "'production', 'development', 'both'"), _UNUSED_TABLES)
def unused_files(c: Canon) -> DataFrame:
    return A.unused_files(roled_files(c), graph.reach(c["edges"], seeds(c)), c["edges"], c["pressure"])


@query(_unused("AND role NOT IN ('test', 'story')", "'production', 'both'"), _UNUSED_TABLES)
def unused_files_prod(c: Canon) -> DataFrame:
    return A.unused_files(roled_files(c), graph.reach(c["edges"], seeds(c, ("production", "both"))), c["edges"], c["pressure"], production=True)


def _brand_targets(c: Canon) -> DataFrame:
    return c["files"].where("package = 'brand-5'").select(F.col("file_id").alias("target"), F.col("file_id").alias("node"))


@query("""t AS (SELECT file_id AS n FROM files WHERE package = 'brand-5'), r(t, n) AS (SELECT n, n FROM t UNION SELECT r.t, e.src FROM r JOIN edges e ON e.dst = r.n),
    a AS (SELECT r.t AS target, count(*) AS files, string_agg(DISTINCT f.package, ',' ORDER BY f.package) AS packages FROM r JOIN files f ON f.file_id = r.n GROUP BY r.t),
    k AS (SELECT r.t AS target, string_agg(DISTINCT kind, ',' ORDER BY kind) AS ks FROM r JOIN entries e ON e.file_id = r.n GROUP BY r.t)
    SELECT target, files, packages, coalesce(ks, '') AS entry_kinds FROM a LEFT JOIN k USING (target)""", ("files", "edges", "entries"))  # fmt: skip
def impact_targets(c: Canon) -> DataFrame:
    reached = graph.reach_sets(graph.reversed_edges(c["edges"]), _brand_targets(c).withColumnRenamed("target", "label"))
    return A.impact(reached.withColumnRenamed("label", "target"), c["files"], c["entries"])


# Levels first, each all nodes that the one before makes new; then least paths from level to level.
@query(_SEEDS + """lv(h, front, seen) AS (SELECT 0, list(DISTINCT n), list(DISTINCT n) FROM seeds
      UNION ALL SELECT h + 1, new, list_concat(seen, new) FROM (SELECT h, any_value(seen) AS seen, list(DISTINCT e.dst) FILTER (NOT list_contains(seen, e.dst)) AS new FROM lv JOIN edges e ON list_contains(front, e.src) GROUP BY h) WHERE len(new) > 0),
    pl AS (SELECT h, unnest(front) AS n FROM lv),
    st AS (SELECT DISTINCT a.h, a.n AS src, b.n AS dst FROM edges e JOIN pl a ON a.n = e.src JOIN pl b ON b.n = e.dst AND b.h = a.h + 1),
    d(n, h, p) AS (SELECT n, 0, [n] FROM pl WHERE h = 0 UNION ALL SELECT dst, h + 1, min(p) FROM (SELECT st.dst, d.h, list_append(d.p, st.dst) AS p FROM d JOIN st ON st.src = d.n AND st.h = d.h) GROUP BY dst, h)
    SELECT n AS node, CAST(h AS BIGINT) AS hop, array_to_string(p, '>') AS path FROM d WHERE h > 0""", ("edges", "entries"))  # fmt: skip
def shortest_proof(c: Canon) -> DataFrame:
    found = graph.shortest_proofs(c["edges"], seeds(c)).where("hop > 0")
    return found.select("node", F.col("hop").cast("long").alias("hop"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("r(k, n) AS (SELECT DISTINCT kind, file_id FROM entries UNION SELECT r.k, e.dst FROM r JOIN edges e ON e.src = r.n) SELECT n AS node, string_agg(DISTINCT k, ',' ORDER BY k) AS kinds FROM r GROUP BY n".replace("r(k", " r(k"), ("edges", "entries"))
def entry_kind_labels(c: Canon) -> DataFrame:
    found = graph.reach_sets(c["edges"], c["entries"].select(F.col("kind").alias("label"), F.col("file_id").alias("node")))
    return found.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("kinds"))


_PAIRS = "p(a, b) AS (SELECT src, dst FROM user_edges UNION SELECT p.a, e.dst FROM p JOIN user_edges e ON e.src = p.b) "


@query(_PAIRS + "SELECT a, b FROM p", ("user_edges",))
def closure_pairs(c: Canon) -> DataFrame:
    return graph.closure(c["user_edges"])


@query(_PAIRS + "SELECT x.a AS node, min(x.b) AS component FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a IN (SELECT u.a FROM p u JOIN p v ON u.a = v.b AND u.b = v.a AND u.a <> u.b) GROUP BY x.a", ("user_edges",))
def scc_users(c: Canon) -> DataFrame:
    return graph.strong_components(c["user_edges"])


@query(_PAIRS + """, s AS (SELECT x.a AS node, min(x.b) AS component FROM p x JOIN p y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
    e AS (SELECT u.src, u.dst, a.component AS c FROM user_edges u JOIN s a ON a.node = u.src JOIN s b ON b.node = u.dst AND a.component = b.component),
    w(c, n, l) AS (SELECT DISTINCT component, component, 0 FROM s UNION SELECT w.c, e.dst, l + 1 FROM w JOIN e ON e.src = w.n AND e.c = w.c WHERE l < 40 AND (l = 0 OR w.n <> w.c))
    SELECT c AS component, CAST(min(l) AS BIGINT) AS length FROM w WHERE l > 0 AND n = c GROUP BY c""", ("user_edges",))  # fmt: skip
def cycle_lengths(c: Canon) -> DataFrame:
    components = graph.strong_components(c["user_edges"])
    found = graph.cycle_chains(c["user_edges"], components)
    return found.select("component", (F.col("length") - 1).cast("long").alias("length"))


_LIVE = _REACH + """
    l AS (SELECT reexporter, source, original, exported, is_star FROM reexports WHERE reexporter IN (SELECT n FROM r)),
    d(file, is_type, name) AS (
      SELECT * FROM (SELECT file_id, t.t, '*' FROM entries CROSS JOIN (VALUES (false), (true)) AS t(t) UNION SELECT source, is_type, name FROM imports WHERE importer IN (SELECT n FROM r))
      UNION SELECT l.source, d.is_type, CASE WHEN l.is_star THEN d.name ELSE l.original END FROM d JOIN l ON l.reexporter = d.file AND NOT d.is_type AND (l.is_star OR d.name = '*' OR d.name = l.exported)), """
_LIVE_TABLES = ("edges", "entries", "files", "imports", "reexports", "exports")


def _demand(c: Canon) -> tuple[DataFrame, DataFrame]:
    reached = Rounds(c.spark).table(graph.reach(_written(c, "edges"), seeds(c)).select(F.col("node").alias("file")))
    entries = c["entries"].select(F.col("file_id").alias("file")).distinct()
    return liveness.demand(c["imports"], c["reexports"], reached, entries), reached


@query(_LIVE.rstrip(", \n") + " SELECT file, is_type, name FROM d", _LIVE_TABLES)
def export_demand(c: Canon) -> DataFrame:
    return _demand(c)[0].select("file", "is_type", "name")


@query(_LIVE + _ROLED + """lv AS (SELECT DISTINCT e.file, e.name FROM exports e JOIN d ON d.file = e.file AND (d.name = e.name OR d.name = '*'))
    SELECT CASE WHEN e.is_type THEN 'unused-type' ELSE 'unused-export' END AS code, concat(rel_path, '#', e.name) AS subject FROM exports e JOIN roled f ON f.file_id = e.file
    WHERE e.file IN (SELECT n FROM r) AND role NOT IN ('fixture', 'example', 'template', 'benchmark', 'config', 'generated', 'buildOutput') AND NOT regexp_matches(rel_path, '\\.d\\.[mc]?ts$') AND (e.file, e.name) NOT IN (SELECT (file, name) FROM lv)""", _LIVE_TABLES)  # fmt: skip
def unused_exports(c: Canon) -> DataFrame:
    wanted, reached = _demand(c)
    live = liveness.live_exports(c["exports"], wanted).select(F.col("file").alias("__f"), F.col("name").alias("__n"))
    files = roled_files(c).where(C.dead_code_candidate(F.col("role"), F.col("rel_path")))
    dead = c["exports"].join(reached.toDF("__r"), F.col("file") == F.col("__r"), "left_semi").join(live, (F.col("file") == F.col("__f")) & (F.col("name") == F.col("__n")), "left_anti")
    return dead.join(files, F.col("file") == F.col("file_id")).select(F.when(F.col("is_type"), "unused-type").otherwise("unused-export").alias("code"), F.concat_ws("#", "rel_path", "name").alias("subject"))


@query("""m AS (SELECT x.file, x.parent, x.member, (x.file, x.parent, x.member) IN (SELECT (file, parent, member) FROM member_refs WHERE access <> 'write') AS live FROM members x),
    s AS (SELECT file, parent FROM m GROUP BY file, parent HAVING bool_or(live) AND NOT bool_and(live)) SELECT m.file, m.parent, m.member FROM m JOIN s ON s.file = m.file AND s.parent = m.parent WHERE NOT live""", ("members", "member_refs"))  # fmt: skip
def unused_members(c: Canon) -> DataFrame:
    return liveness.unused_members(c["members"], c["member_refs"])


@query("SELECT source, original, string_agg(concat(reexporter, ':', exported), ',' ORDER BY reexporter, exported) AS paths FROM (SELECT DISTINCT source, original, reexporter, exported FROM reexports WHERE NOT is_star) GROUP BY source, original HAVING count(*) >= 2", ("reexports",))
def duplicate_exports(c: Canon) -> DataFrame:
    found = A.duplicate_exports(c["reexports"])
    return found.select("source", "original", F.array_join(F.transform("paths", lambda p: F.concat_ws(":", p["reexporter"].cast("string"), p["exported"])), ",").alias("paths"))


_DEPS = ("declared", "used")


@query("SELECT DISTINCT d.* FROM declared d ANTI JOIN used u ON u.workspace = d.workspace AND u.dep = d.dep", _DEPS)
def unused_deps(c: Canon) -> DataFrame:
    return A.unused_dependencies(c["declared"], c["used"])


@query("SELECT DISTINCT d.* FROM declared d ANTI JOIN used u ON u.workspace = d.workspace AND u.dep = d.dep WHERE dep_kind = 'dependency' AND dep NOT IN ('brand-1', 'brand-2')", _DEPS)
def unused_deps_prod(c: Canon) -> DataFrame:
    spark = c.spark
    return A.unused_dependencies(c["declared"].where("dep_kind = 'dependency'"), c["used"], spark.createDataFrame([("brand-1",), ("brand-2",)], "dep string"))


@query("SELECT DISTINCT u.workspace, u.dep FROM used u ANTI JOIN declared d ON u.workspace = d.workspace AND u.dep = d.dep WHERE regexp_matches(u.dep, '^[a-z0-9]')", _DEPS)
def unlisted_deps(c: Canon) -> DataFrame:
    return A.unlisted_dependencies(c["declared"], c["used"])


# Packages of a brand's files of one size: brands as a whole are all reached.
@query(_REACH + "s AS (SELECT 1) SELECT concat(package, '-', p_size) AS package, count(*) AS files FROM files GROUP BY 1 HAVING NOT bool_or(file_id IN (SELECT n FROM r))", ("files", "edges", "entries"))
def unused_packages(c: Canon) -> DataFrame:
    return A.unused_packages(c["files"].withColumn("package", F.concat_ws("-", "package", "p_size")), graph.reach(c["edges"], seeds(c)))


TEAMS = [("team-b", "promo/src/**"), ("team-a", "**/brand-1/*.ts")]
OWNERS = [("economy/", "@eco"), ("*.config.ts", "@build"), ("/large/src/**", "@large"), ("standard", "@std")]
_OWNED = """owned AS (SELECT *, CASE WHEN regexp_matches(rel_path, '^(?:.*/)?brand-1/.*\\.ts$') THEN 'team-a' WHEN regexp_matches(rel_path, '^promo/src/.*$') THEN 'team-b'
    WHEN starts_with(rel_path, 'standard') THEN '@std' WHEN starts_with(rel_path, 'large/src/') THEN '@large' WHEN ends_with(rel_path, '.config.ts') THEN '@build' WHEN starts_with(rel_path, 'economy/') THEN '@eco' END AS owner FROM files), """
_CROSS = _OWNED + "x AS (SELECT DISTINCT e.src, e.dst, a.owner AS src_owner, b.owner AS dst_owner FROM edges e JOIN owned a ON a.file_id = e.src JOIN owned b ON b.file_id = e.dst WHERE a.owner <> b.owner) "


def _owned(c: Canon) -> DataFrame:
    return A.owned(c["files"], TEAMS, OWNERS)


@query(_OWNED.rstrip(", ") + " SELECT file_id, owner FROM owned", ("files",))
def owner_map(c: Canon) -> DataFrame:
    return _owned(c).select("file_id", "owner")


@query(_OWNED + f"z AS (SELECT file_id, rel_path FROM owned WHERE owner IS NULL AND {_roles('rel_path')} NOT IN ('fixture', 'example', 'template', 'benchmark', 'config', 'generated', 'buildOutput')) SELECT * FROM z", ("files",))
def unowned(c: Canon) -> DataFrame:
    return _owned(c).where(F.col("owner").isNull() & ~C.file_role(F.col("rel_path")).isin(*C.NOT_DEAD)).select("file_id", "rel_path")


@query(_CROSS + "SELECT * FROM x", ("files", "edges"))
def cross_owner(c: Canon) -> DataFrame:
    return A.cross_owner(c["edges"], _owned(c))


@query(_CROSS + "SELECT dst, count(DISTINCT src_owner) AS owners, count(*) AS edges FROM x GROUP BY dst HAVING count(DISTINCT src_owner) >= 2", ("files", "edges"))
def owner_hotspots(c: Canon) -> DataFrame:
    return A.owner_hotspots(A.cross_owner(c["edges"], _owned(c)))


def _contexts(c: Canon) -> DataFrame:
    kinds = graph.reach_sets(c["edges"], c["entries"].select(F.struct("kind", "profile").alias("label"), F.col("file_id").alias("node"))).groupBy(F.col("node").alias("__n")).agg(F.collect_set("label.kind").alias("entry_kinds"), F.collect_set("label.profile").alias("profiles"))
    base = c["files"].select(F.col("file_id").alias("node"), F.col("rel_path").alias("path"), "workspace", "package", F.array(F.concat(F.lit("ws:"), F.col("workspace"))).alias("tags"))
    return base.join(kinds, F.col("node") == F.col("__n"), "left").drop("__n")


def _ruled(c: Canon, *forbidden: rules.Forbidden, full: bool = False) -> DataFrame:
    edges = _written(c, "edges")
    contexts = _contexts(c) if full else c["files"].select(F.col("file_id").alias("node"), F.col("rel_path").alias("path"), "workspace", "package", F.array(F.concat(F.lit("ws:"), F.col("workspace"))).alias("tags"))
    return rules.violations(edges, contexts, list(forbidden)).select("rule", "src", "dst", "subject")


def _rule_sql(name: str, where: str, before: str = "") -> str:
    return before + f"z AS (SELECT DISTINCT '{name}' AS rule, e.src, e.dst, concat(a.rel_path, ' -> ', b.rel_path) AS subject FROM edges e JOIN files a ON a.file_id = e.src JOIN files b ON b.file_id = e.dst WHERE {where}) SELECT * FROM z"


_RT = ("files", "edges")


@query(_rule_sql("no-promo", "starts_with(a.rel_path, 'economy/') AND regexp_matches(b.rel_path, '^promo/.*/src/|^promo/src/')"), _RT)
def rule_path(c: Canon) -> DataFrame:
    return _ruled(c, rules.Forbidden("no-promo", rules.End(path=("economy/**",)), rules.End(path=("promo/**/src/**", "promo/src/**"))))


@query(_rule_sql("only-own", "a.package = 'brand-4' AND b.package <> 'brand-4'"), _RT)
def rule_package_not(c: Canon) -> DataFrame:
    return _ruled(c, rules.Forbidden("only-own", rules.End(package=("brand-4",)), rules.End(package_not=("brand-4",))))


@query(_rule_sql("no-types", "e.kind = 'StaticImportType' AND a.workspace <> 'small'"), _RT)
def rule_kinds(c: Canon) -> DataFrame:
    return _ruled(c, rules.Forbidden("no-types", rules.End(workspace_not=("small",)), rules.End(kinds=("type",))))


@query(_rule_sql("tags", "a.workspace = 'large' AND b.workspace <> 'large'"), _RT)
def rule_tags(c: Canon) -> DataFrame:
    return _ruled(c, rules.Forbidden("tags", rules.End(tag=("ws:large",)), rules.End(tag_not=("ws:large",))))


_KINDS = "k(k, p, n) AS (SELECT DISTINCT kind, profile, file_id FROM entries UNION SELECT k.k, k.p, e.dst FROM k JOIN edges e ON e.src = k.n), "


@query(_rule_sql("profiles", "e.src IN (SELECT n FROM k WHERE p = 'development') AND e.dst IN (SELECT n FROM k WHERE k = 'package-bin')", _KINDS), (*_RT, "entries"))
def rule_profiles(c: Canon) -> DataFrame:
    return _ruled(c, rules.Forbidden("profiles", rules.End(profiles=("development",)), rules.End(entry_kinds=("package-bin",))), full=True)


@query(_rule_sql("from", "e.src IN (SELECT n FROM f)", "f(n) AS (SELECT file_id FROM files WHERE regexp_matches(rel_path, '^medium/.*/brand-6/') UNION SELECT e.dst FROM f JOIN edges e ON e.src = f.n), "), _RT)
def rule_reachable_from(c: Canon) -> DataFrame:
    return _ruled(c, rules.Forbidden("from", rules.End(reachable_from=("medium/*/brand-6/**",))))


@query(_rule_sql("reaches", "e.src IN (SELECT n FROM f) AND b.workspace = 'economy'", "f(n) AS (SELECT file_id FROM files WHERE regexp_matches(rel_path, '^medium/.*/brand-6/') UNION SELECT e.src FROM f JOIN edges e ON e.dst = f.n), "), _RT)
def rule_reaches(c: Canon) -> DataFrame:
    return _ruled(c, rules.Forbidden("reaches", rules.End(reaches=("medium/*/brand-6/**",)), rules.End(workspace=("economy",))))


# Findings for the report operators: one per file that nothing imports, with levels from its size.
_FOUND = """found AS (SELECT substr(sha256(concat_ws('|', 'unused-file', rel_path, '')), 1, 16) AS id, 'unused-file' AS code, CASE p_size % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END AS severity,
    CASE WHEN p_size < 20 THEN 'high' WHEN p_size < 40 THEN 'medium' ELSE 'low' END AS confidence, rel_path AS subject, file_id, p_size, workspace FROM files WHERE file_id NOT IN (SELECT dst FROM edges)), """


def _found(c: Canon) -> DataFrame:
    rows = c["files"].join(c["edges"].select("dst").distinct(), F.col("file_id") == F.col("dst"), "left_anti")
    severity = F.when(F.col("p_size") % 3 == 0, "error").when(F.col("p_size") % 3 == 1, "warn").otherwise("info")
    confidence = F.when(F.col("p_size") < 20, "high").when(F.col("p_size") < 40, "medium").otherwise("low")
    return rows.select(C.finding_id(F.lit("unused-file"), F.col("rel_path"), F.lit("")).alias("id"), F.lit("unused-file").alias("code"), severity.alias("severity"), confidence.alias("confidence"), F.col("rel_path").alias("subject"), "file_id", "p_size", "workspace")


def _plain(found: DataFrame) -> DataFrame:
    return found.select("id", "code", "severity", "confidence", "subject")


_COLS = "id, code, severity, confidence, subject"


@query(_FOUND + f"z AS (SELECT {_COLS} FROM found WHERE file_id % 3 <> 0) SELECT * FROM z", _RT)
def baseline_new(c: Canon) -> DataFrame:
    found = _found(c)
    return _plain(report.new_findings(found, found.where("file_id % 3 = 0").select("id")))


@query(_FOUND + f"ch AS (SELECT file_id AS n FROM files WHERE file_id % 17 = 0), r(n) AS (SELECT n FROM ch UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.n) SELECT {_COLS} FROM found WHERE file_id IN (SELECT n FROM r)", _RT)
def changed_scope(c: Canon) -> DataFrame:
    changed = c["files"].where("file_id % 17 = 0").select(F.col("file_id").alias("node"))
    scope = graph.reach(graph.reversed_edges(c["edges"]), changed).join(c["files"], F.col("node") == F.col("file_id")).select(F.col("rel_path").alias("path"))
    return _plain(report.in_scope(_found(c), scope))


@query(_FOUND + f"z AS (SELECT {_COLS} FROM found WHERE regexp_matches(subject, '^promo/.*/brand-1/')) SELECT * FROM z", _RT)
def focus_findings(c: Canon) -> DataFrame:
    return _plain(report.focused(_found(c), ["promo/*/brand-1/**"]))


@query(_FOUND + f"z AS (SELECT {_COLS} FROM found WHERE NOT starts_with(subject, 'small/')) SELECT * FROM z", _RT)
def ignored_findings(c: Canon) -> DataFrame:
    return _plain(report.suppressed(_found(c), [("unused-file", ["small/**"]), ("cycle", ["**"])]))


@query(_FOUND + f"z AS (SELECT {_COLS} FROM found WHERE severity IN ('error', 'warn') ORDER BY id LIMIT 25) SELECT * FROM z", _RT)
def severity_topn(c: Canon) -> DataFrame:
    return _plain(report.top(_found(c), 25, ["error", "warn"]))


@query(_FOUND + """z AS (SELECT count(*) AS total, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info,
    count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM found) SELECT * FROM z""", _RT)  # fmt: skip
def summary_counts(c: Canon) -> DataFrame:
    return report.counts(_found(c))


@query(_FOUND + "z AS (SELECT id, CASE WHEN NOT starts_with(subject, 'large/') THEN confidence WHEN confidence = 'high' THEN 'medium' ELSE 'low' END AS confidence FROM found) SELECT * FROM z", _RT)
def trust_downgrade(c: Canon) -> DataFrame:
    return report.downgraded(_found(c), ["large/**"]).select("id", "confidence")


@query(_FOUND + "z AS (SELECT id, CASE WHEN confidence = 'high' AND severity <> 'info' THEN 'blocking' ELSE 'advisory' END AS decision FROM found) SELECT * FROM z", _RT)
def review_split(c: Canon) -> DataFrame:
    return report.reviewed(_found(c)).select("id", "decision")


@query(_FOUND + """t AS (SELECT file_id, rel_path AS path FROM files WHERE package = 'brand-8'), dep AS (SELECT DISTINCT path FROM t JOIN edges e ON e.dst = t.file_id WHERE e.src NOT IN (SELECT file_id FROM t)),
    z AS (SELECT path, CASE WHEN confidence IS NULL OR path IN (SELECT path FROM dep) THEN 'blocked' WHEN confidence = 'high' THEN 'safe' ELSE 'needs-review' END AS verdict FROM t LEFT JOIN found ON subject = path) SELECT * FROM z""", _RT)  # fmt: skip
def safe_delete(c: Canon) -> DataFrame:
    targets = c["files"].where("package = 'brand-8'").select("file_id", F.col("rel_path").alias("path"))
    ids = targets.select(F.col("file_id").alias("__t"))
    outside = c["edges"].join(ids, F.col("src") == F.col("__t"), "left_anti").join(targets, F.col("dst") == F.col("file_id")).select("path")
    return report.safe_delete(targets.select("path"), _found(c), outside, 4)


@query("""s AS (SELECT file_id, rel_path AS path FROM files WHERE package = 'brand-9'), d AS (SELECT dst, count(*) AS k FROM edges WHERE src IN (SELECT file_id FROM s) GROUP BY dst)
    SELECT path, coalesce(k, 0) AS indegree, row_number() OVER (ORDER BY coalesce(k, 0), path) AS position FROM s LEFT JOIN d ON d.dst = s.file_id""", _RT)  # fmt: skip
def deletion_order(c: Canon) -> DataFrame:
    safe = c["files"].where("package = 'brand-9'").select("file_id", F.col("rel_path").alias("path"))
    return report.deletion_order(safe, c["edges"]).select("path", "indegree", F.col("position").cast("long").alias("position"))


@query(_FOUND + "z AS (SELECT 1 AS phase, CAST(count(*) AS BIGINT) AS actions, max(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS risk, min(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS best FROM found) SELECT * FROM z", _RT)
def phase_summary(c: Canon) -> DataFrame:
    return report.phases(report.ranked_actions(_found(c)))


@query(_FOUND + "z AS (SELECT id, row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id) AS rank FROM found) SELECT * FROM z", _RT)
def action_rank(c: Canon) -> DataFrame:
    return report.ranked_actions(_found(c)).select("id", F.col("rank").cast("long").alias("rank"))


@query(_FOUND + """z AS (SELECT id, concat('{"ruleId":"unused-file","level":"', CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END, '","message":{"text":"', subject, '"}}') AS result FROM found) SELECT * FROM z""", _RT)
def sarif_rows(c: Canon) -> DataFrame:
    return report.sarif(_found(c))


_COUPLED = """cp AS (SELECT a.package AS src_pkg, b.package AS dst_pkg, count(*) AS total, count(*) FILTER (kind = 'StaticImportType') AS type_only, count(*) FILTER (kind = 'DynamicImport') AS dynamic,
    count(*) FILTER (kind NOT IN ('StaticImportType', 'DynamicImport')) AS value, count(DISTINCT src) AS sources FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst
    WHERE a.package <> b.package AND kind IN ('StaticImportValue', 'StaticImportType', 'DynamicImport') GROUP BY a.package, b.package) """


@query(_COUPLED + "SELECT * FROM cp", _RT)
def pkg_coupling(c: Canon) -> DataFrame:
    return G.package_coupling(c["edges"], c["files"])


@query(_COUPLED + "SELECT src_pkg, dst_pkg, total, CASE WHEN total >= 9 THEN 'high' WHEN total >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM cp WHERE total >= 3", _RT)
def rule_suggestions(c: Canon) -> DataFrame:
    return G.forbidden_suggestions(G.package_coupling(c["edges"], c["files"]))


@query(_COUPLED + "SELECT x.src_pkg AS a, x.dst_pkg AS b, x.total AS there, y.total AS back, CASE WHEN x.total + y.total >= 12 THEN 'high' WHEN x.total + y.total >= 6 THEN 'medium' ELSE 'low' END AS confidence FROM cp x JOIN cp y ON x.src_pkg = y.dst_pkg AND x.dst_pkg = y.src_pkg AND x.src_pkg < x.dst_pkg WHERE x.total >= 2 AND y.total >= 2", _RT)
def mutual_coupling(c: Canon) -> DataFrame:
    return G.mutual_coupling(G.package_coupling(c["edges"], c["files"]))


@query("SELECT regexp_extract(rel_path, '^([^/]*/[^/]*)/', 1) AS directory, count(*) AS files FROM files GROUP BY 1 HAVING count(*) >= 3", ("files",))
def dir_tags(c: Canon) -> DataFrame:
    return G.directory_tags(c["files"])


# Groups of a brand's files of one size: of whole brands none is top or leaf.
@query("""g AS (SELECT file_id, concat(package, '-', p_size) AS w FROM files), x AS (SELECT DISTINCT a.w AS s, b.w AS d FROM edges JOIN g a ON a.file_id = src JOIN g b ON b.file_id = dst WHERE a.w <> b.w),
    t AS (SELECT DISTINCT s FROM x WHERE s NOT IN (SELECT d FROM x)), l AS (SELECT DISTINCT d FROM x WHERE d NOT IN (SELECT s FROM x)),
    k AS (SELECT 1 FROM x HAVING count(DISTINCT s) >= 3) SELECT s AS top, string_agg(d, ',' ORDER BY d) AS leaves FROM t CROSS JOIN l CROSS JOIN k GROUP BY s""", _RT)  # fmt: skip
def layer_rules(c: Canon) -> DataFrame:
    files = c["files"].select("file_id", F.concat_ws("-", "package", "p_size").alias("workspace"))
    return G.layers(c["edges"], files).withColumn("leaves", F.array_join("leaves", ","))


@query("""u AS (SELECT DISTINCT src, dst, (SELECT package FROM files WHERE file_id = src) <> (SELECT package FROM files WHERE file_id = dst) AS x FROM edges),
    v AS (SELECT dst AS file_id, 1 AS i, 0 AS o, x FROM u UNION ALL SELECT src, 0, 1, x FROM u),
    h AS (SELECT file_id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(CAST(x AS INT)) AS BIGINT) AS cross_package FROM v GROUP BY file_id HAVING sum(i) + sum(o) >= 5)
    SELECT *, row_number() OVER (ORDER BY fan_in + fan_out DESC, cross_package DESC, file_id) AS rank FROM h QUALIFY rank <= 20""", _RT)  # fmt: skip
def hotspots_top20(c: Canon) -> DataFrame:
    return G.hotspots(c["edges"], c["files"]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT a.workspace AS folder, count(*) AS edges FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst WHERE a.package <> b.package GROUP BY 1 HAVING count(*) >= 3", _RT)
def ownership_hints(c: Canon) -> DataFrame:
    return G.ownership_hints(c["edges"], c["files"])


@query("SELECT family, tool, CASE WHEN grouping(family) = 1 AND grouping(tool) = 1 THEN 'overall' WHEN grouping(family) = 0 THEN 'family' ELSE 'tool' END AS level, count(*) AS cases, count(*) FILTER (ok) AS passed, round(100.0 * count(*) FILTER (ok) / count(*), 4) AS score FROM parity GROUP BY GROUPING SETS ((), (family), (tool))", ("parity",))
def parity_grouping_sets(c: Canon) -> DataFrame:
    return G.parity_scores(c["parity"])


@query(f"SELECT {_roles('rel_path')} AS role, count(*) AS files FROM files GROUP BY 1", ("files",))
def role_counts(c: Canon) -> DataFrame:
    return roled_files(c).groupBy("role").agg(F.count("*").alias("files"))


_HREFS = "h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS specifier FROM pages) "


def _hrefs(c: Canon) -> DataFrame:
    return c.read("pages").select("page_id", F.explode_outer(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("specifier")).where("specifier is not null")


@query("WITH " + _HREFS + "SELECT page_id, count(*) AS links, count(DISTINCT specifier) AS specifiers, count(*) FILTER (starts_with(specifier, '/')) AS absolute FROM h GROUP BY page_id")
def page_specifiers(c: Canon) -> DataFrame:
    return _hrefs(c).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("specifier").alias("specifiers"), F.count_if(F.col("specifier").startswith("/")).alias("absolute"))


@query("WITH " + _HREFS + "SELECT CASE WHEN regexp_matches(specifier, '^(node|bun|deno):') THEN 'externalized' WHEN regexp_matches(specifier, '^(virtual:|~)|\\$\\{|[*?]|" + C.ASSETS + "') THEN 'unsupported-specifier' WHEN starts_with(specifier, '#') THEN 'exports-condition-miss' ELSE 'missing-file' END AS reason, count(*) AS links FROM h GROUP BY 1")
def unresolved_by_reason(c: Canon) -> DataFrame:
    return _hrefs(c).groupBy(C.unresolved_reason(F.col("specifier")).alias("reason")).agg(F.count("*").alias("links"))


@query("WITH x AS (SELECT regexp_extract(url, '://(.*)$', 1) AS specifier FROM pages) SELECT regexp_extract(specifier, '^(@[^/]*/[^/]*|[^./@][^/]*)', 1) AS dep, count(*) AS pages FROM x GROUP BY 1")
def dependency_names(c: Canon) -> DataFrame:
    spec = F.regexp_extract("url", "://(.*)$", 1)
    return c.read("pages").groupBy(C.dependency_name(spec).alias("dep")).agg(F.count("*").alias("pages"))


@query("""w(root, ws) AS (VALUES ('economy', 'w-eco'), ('economy/src', 'w-eco-src'), ('promo', 'w-promo'), ('', 'w-root'))
    SELECT file_id, ws AS found FROM files JOIN w ON root = '' OR starts_with(rel_path, root || '/') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY length(root) DESC) = 1""".replace("w(root", " w(root"), ("files",))  # fmt: skip
def workspace_prefix_join(c: Canon) -> DataFrame:
    from graphloom.sources.repo import inventory

    roots = c.spark.createDataFrame([("economy", "w-eco"), ("economy/src", "w-eco-src"), ("promo", "w-promo"), ("", "w-root")], "root string, workspace string")
    return inventory(c["files"].select("file_id", "rel_path"), roots).select("file_id", F.col("workspace").alias("found"))


@query("""sp AS (SELECT DISTINCT a.rel_path AS src, concat('../', regexp_extract(b.rel_path, '([^/]*)/[^/]*$', 1), '/f', b.file_id) AS specifier, regexp_replace(a.rel_path, '/[^/]*/[^/]*$', '') AS base FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst),
    c AS (SELECT src, specifier, concat(base, substr(specifier, 3)) AS p FROM sp) SELECT src, specifier, f.rel_path AS dst_file, CASE WHEN f.rel_path IS NULL THEN 'Unresolved' ELSE 'ResolvedToFile' END AS outcome FROM c LEFT JOIN files f ON f.rel_path = c.p || '.ts' OR f.rel_path = c.p || '.d.ts'""", _RT)  # fmt: skip
def resolve_priority(c: Canon) -> DataFrame:
    a, b = c["files"].select(F.col("file_id").alias("__a"), F.col("rel_path").alias("src_path")), c["files"].select(F.col("file_id").alias("__b"), F.col("rel_path").alias("dst_path"))
    specs = c["edges"].join(a, F.col("src") == F.col("__a")).join(b, F.col("dst") == F.col("__b")).select(F.col("src_path").alias("src"), F.concat(F.lit("../"), F.regexp_extract("dst_path", r"([^/]*)/[^/]*$", 1), F.lit("/f"), F.col("__b")).alias("specifier"))
    return resolve.resolved(specs, c["files"]).select("src", "specifier", "dst_file", "outcome")


@query("""g AS (SELECT DISTINCT package AS src, concat('*/src/', package, '/*.ts') AS pattern, concat('/src/', package, '/') AS body FROM files WHERE package IN ('brand-1', 'brand-2'))
    SELECT src, pattern, rel_path AS path FROM g JOIN files f ON contains(f.rel_path, body) AND ends_with(f.rel_path, '.ts') QUALIFY row_number() OVER (PARTITION BY src, pattern ORDER BY rel_path) <= 10""", ("files",))  # fmt: skip
def glob_expand_cap(c: Canon) -> DataFrame:
    globs = [f"*/src/{p}/*.ts" for p in ("brand-1", "brand-2")]
    patterns = c["files"].where("package in ('brand-1', 'brand-2')").select(F.col("package").alias("src"), F.concat(F.lit("*/src/"), F.col("package"), F.lit("/*.ts")).alias("glob")).distinct()
    return resolve.expanded_globs(patterns, c["files"], globs, cap=10).withColumnRenamed("glob", "pattern")


@query("""a AS (SELECT rel_path AS path, kind, profile, 0 AS o FROM entries JOIN files USING (file_id)), b AS (SELECT rel_path AS path, 'convention' AS kind, 'both' AS profile, 1 AS o FROM files WHERE p_size < 8)
    SELECT path, kind, profile FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY path ORDER BY o, kind, profile) = 1""", ("files", "entries"))  # fmt: skip
def entrypoint_dedupe(c: Canon) -> DataFrame:
    first = c["entries"].join(c["files"].select(F.col("file_id").alias("__f"), F.col("rel_path").alias("path")), F.col("file_id") == F.col("__f"))
    second = c["files"].where("p_size < 8").select(F.col("rel_path").alias("path"), F.lit("convention").alias("kind"), F.lit("both").alias("profile"))
    return resolve.merged_entries([first, second])


@query("r(t, n) AS (SELECT dst, dst FROM hierarchy WHERE starts_with(dst, 'region:') UNION SELECT r.t, h.src FROM r JOIN hierarchy h ON h.dst = r.n) SELECT t AS target, split_part(n, ':', 1) AS kind, count(*) AS nodes FROM r GROUP BY ALL", ("hierarchy",))
def hierarchy_impact(c: Canon) -> DataFrame:
    regions = c["hierarchy"].where("dst like 'region:%'").select(F.col("dst").alias("target"), F.col("dst").alias("node")).distinct()
    found = graph.reach(graph.reversed_edges(c["hierarchy"]), regions)
    return found.groupBy("target", F.substring_index("node", ":", 1).alias("kind")).agg(F.count("*").alias("nodes"))


@query("SELECT CASE event_type WHEN 'error' THEN 'manifest' WHEN 'click' THEN 'tsconfig' WHEN 'view' THEN 'source' WHEN 'signup' THEN 'codeowners' END AS invalidates, count(*) AS changes FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def change_invalidations(c: Canon) -> DataFrame:
    names = {"error": "a/package.json", "click": "tsconfig.base.json", "view": "src/a.ts", "signup": "CODEOWNERS", "purchase": "notes.txt"}
    path = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return c.read("events").groupBy(invalidation(path).alias("invalidates")).agg(F.count("*").alias("changes")).where("invalidates is not null")


@query("""t AS (SELECT workspace AS g, count(*) AS n, 'workspace' AS source, 'ws-' AS mark FROM files GROUP BY 1 UNION ALL SELECT package, count(*), 'package', 'pkg-' FROM files GROUP BY 1)
    SELECT mark || regexp_replace(g, '[/@.]', '-', 'g') AS name, g AS "glob", source, n AS files FROM t WHERE n >= 3""", ("files",))  # fmt: skip
def structure_tags(c: Canon) -> DataFrame:
    return tags.structure_tags(c["files"])


@query("""d AS (SELECT CAST(regexp_extract(dep, '[0-9]+$') AS INT) AS k, dep_kind FROM declared),
    s(k, dep, tag, o) AS (VALUES (1, 'react', 'react', 1), (2, 'react-dom', 'react', 2), (3, 'vue', 'vue', 4), (4, 'jest', 'jest', 25), (5, 'hono', 'hono', 15))
    SELECT 'framework-' || tag AS name, arg_min(s.dep, s.o) AS dep FROM d JOIN s USING (k) GROUP BY 1""", ("declared",))  # fmt: skip
def framework_tags(c: Canon) -> DataFrame:
    names = F.array(*map(F.lit, ["react", "react-dom", "vue", "jest", "hono"]))
    number = F.regexp_extract("dep", r"[0-9]+$", 0).cast("int")
    return tags.framework_tags(c["declared"].withColumn("dep", F.coalesce(F.get(names, number - 1), F.col("dep"))))


@query("""n AS (SELECT file_id, CASE p_size % 6 WHEN 0 THEN 'components' WHEN 1 THEN 'hooks' WHEN 2 THEN 'store' WHEN 3 THEN 'lib' END AS r FROM files)
    SELECT 'role-' || r AS name, '**/' || r || '/**' AS "glob", 'file-pattern' AS source, CAST(count(*) * CASE r WHEN 'store' THEN 2 ELSE 1 END AS BIGINT) AS files FROM n WHERE r IS NOT NULL GROUP BY r HAVING count(*) * CASE r WHEN 'store' THEN 2 ELSE 1 END >= 3""", ("files",))  # fmt: skip
def role_tags(c: Canon) -> DataFrame:
    folder = F.get(F.array(*map(F.lit, ["Components", "hooks", "store", "lib", "other", "more"])), F.col("p_size") % 6)
    return tags.role_tags(c["files"].withColumn("rel_path", F.concat(folder, F.lit("/x/"), folder, F.lit("/"), F.col("rel_path"))))


# Groups of a brand's files by number: of whole brands, each has explicit entries.
_FENCED = """e AS (SELECT concat(package, '-', file_id % 40) AS package, kind FROM entries JOIN files USING (file_id)),
    fn AS (SELECT package, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e GROUP BY package HAVING bool_and(kind IN ('package-main', 'package-bin', 'framework-pack')))"""


@query(_FENCED + " SELECT package, kinds FROM fn", ("files", "entries"))
def fence_packages(c: Canon) -> DataFrame:
    group = F.concat_ws("-", "package", (F.col("file_id") % 40).cast("string"))
    files = c["files"].select("file_id", group.alias("package"), F.concat(F.lit("packages/"), group).alias("workspace"))
    seeds = c["entries"].join(files.select(F.col("file_id").alias("__f"), "workspace"), F.col("file_id") == F.col("__f"))
    return tags.fences(seeds, files, kinds=["package-main", "package-bin", "framework-pack"]).select("package", F.array_join("kinds", ",").alias("kinds"))


_EXPORTS = {".": {"import": "./src/index.mjs", "types": "./src/index.d.ts"}, "./a": None, "./f*": {"node": {"default": "./src/f*.ts"}}, "./z/*": ["./lib/*/*.js", "./src/x/*.js"]}


def _manifests(c: Canon) -> DataFrame:
    rows = c["files"].select("workspace").distinct()
    imports = {"#u": "./src/u.ts", "#s/*": {"default": "./src/s/*.ts"}}
    return rows.select("workspace", F.lit("pkg").alias("package"), F.lit(json.dumps(_EXPORTS)).alias("exports"), F.lit(json.dumps(imports)).alias("imports"), F.lit('{"fs": "./shim/fs.js"}').alias("browser"))


@query("""r AS (SELECT workspace, file_id, CASE p_size % 5 WHEN 0 THEN '.' WHEN 1 THEN './a' WHEN 2 THEN concat('./f', file_id) WHEN 3 THEN concat('./z/', file_id) ELSE 'other' END AS specifier FROM files)
    SELECT file_id, specifier, CASE WHEN specifier = '.' THEN '.' WHEN specifier = './a' THEN './a' WHEN starts_with(specifier, './f') THEN './f*' WHEN starts_with(specifier, './z/') THEN './z/*' END AS pattern,
      CASE WHEN specifier = '.' THEN 'src/index.d.ts' WHEN starts_with(specifier, './f') THEN concat('src/f', file_id, '.ts') WHEN starts_with(specifier, './z') THEN concat('lib/', file_id, '/', file_id, '.js') END AS target, specifier <> 'other' AS defined FROM r""", ("files",))  # fmt: skip
def exports_lookup(c: Canon) -> DataFrame:
    size, file = F.col("p_size") % 5, F.col("file_id").cast("string")
    spec = F.when(size == 0, ".").when(size == 1, "./a").when(size == 2, F.concat(F.lit("./f"), file)).when(size == 3, F.concat(F.lit("./z/"), file)).otherwise("other")
    requests = c["files"].select("workspace", "file_id", spec.alias("specifier"))
    maps = manifests.manifest_maps(_manifests(c))
    return manifests.looked_up(requests, maps, "exports").select("file_id", "specifier", "pattern", "target", "defined")


@query("SELECT DISTINCT workspace, CASE WHEN p_size % 2 = 0 THEN concat('src/f', file_id, '.ts') ELSE concat('src/x/', file_id, '.js') END AS path FROM files WHERE p_size % 3 <> 0", ("files",))
def exports_wildcard_files(c: Canon) -> DataFrame:
    file = F.col("file_id").cast("string")
    path = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("test/"), file)).when(F.col("p_size") % 2 == 0, F.concat(F.lit("./src/f"), file, F.lit(".ts"))).otherwise(F.concat(F.lit("src/x/"), file, F.lit(".js")))
    found = manifests.wildcard_files(manifests.manifest_maps(_manifests(c)), c["files"].select("workspace", path.alias("path")))
    return found.select("workspace", F.regexp_replace("path", r"^\./", "").alias("path"))


@query(_FOUND + """z AS (SELECT concat('fix-', id) AS id, subject AS target, confidence, CASE file_id % 4 WHEN 0 THEN 'delete-file' WHEN 1 THEN 'remove-dependency' WHEN 2 THEN 'break-cycle' END AS action,
    CASE file_id % 4 WHEN 0 THEN 'dead-code' WHEN 1 THEN 'dead-code' WHEN 2 THEN 'architecture' END AS phase, CASE file_id % 4 WHEN 0 THEN 'medium' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS risk,
    CASE file_id % 4 WHEN 0 THEN concat('Delete the file `', subject, '`.') WHEN 1 THEN concat('Remove `', subject, '` from package.json dependencies.')
      WHEN 2 THEN concat('Identify the weakest edge in the cycle involving `', subject, '`. Extract the shared dependency or invert the dependency direction.') ELSE '' END AS steps
    FROM found WHERE starts_with(subject, 'promo/src/') OR starts_with(subject, 'small/')) SELECT * FROM z""", _RT)  # fmt: skip
def fix_plan(c: Canon) -> DataFrame:
    codes = F.array(*map(F.lit, ["unused-file", "unused-package", "cycle", "odd"]))
    found = _found(c).withColumn("code", F.get(codes, (F.col("file_id") % 4).cast("int")))
    steps = F.array_join(F.transform("steps", lambda s: s["description"]), " ")
    return fixes.fix_actions(fixes.named(found, ["promo/src/", "small/"])).select("id", "target", "confidence", "action", "phase", "risk", steps.alias("steps"))
