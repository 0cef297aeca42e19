"""Scans of a repository written as texts, and the SQL that says the same of the tables it is written from.

Files are sources whose text imports what their edges tell, in turn by relative paths (every fifth with the ending of the built file), a tsconfig alias, the
package's name (through ``exports`` in every second package) and ``#`` imports, or by a context that fits one file. Every fifth file is named by its manifest as a
built file, two packages name another as their main one, and a script of a third names a source: about half of the files are reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import frameworks, governance, report
from graphloom.operators.tables import Rounds, shuffled
from graphloom.plans.queries import _FOUND, _OWNED, _found, _owned, query
from graphloom.plans.scan import Scan
from graphloom.sources.projections import Canon

EXPORTED = "export const a = 1;\nexport const b = 2;\nexport type T = 1;"
_PATH = "concat('pkgs/', {0}.package, '/src/f', {0}.file_id, '.ts')"
_PATHS = f"p AS (SELECT f.file_id, f.package, {_PATH.format('f')} AS path FROM files f), "
_EDGES = (
    _PATHS
    + """x AS (SELECT a.path AS src, b.path AS dst, kind
    FROM edges JOIN p a ON a.file_id = edges.src JOIN p b ON b.file_id = edges.dst), """
)
_MAIN = "(file_id % 5 = 0 OR file_id IN (SELECT min(file_id) FROM files WHERE package IN ('brand-2', 'brand-3') GROUP BY package))"
_ENTRIES = f"""en AS (SELECT path, 'package-main' AS kind, 'production' AS profile FROM p WHERE {_MAIN}
    UNION ALL SELECT path, 'package-script', 'development' FROM p WHERE file_id = (SELECT max(file_id) FROM files WHERE package = 'brand-4') AND NOT {_MAIN}), """
_REACHED = "r(n) AS (SELECT path FROM en UNION SELECT x.dst FROM r JOIN x ON x.src = r.n), "
_TABLES = ("files", "edges")


def texts(c: Canon) -> DataFrame:
    """Rows (rel_path, text) of the repository."""
    number = F.regexp_extract("package", r"(\d+)$", 1).cast("int")
    path = F.concat(F.lit("pkgs/"), "package", F.lit("/src/f"), "file_id", F.lit(".ts"))
    files = c["files"].select("file_id", "package", number.alias("number"), path.alias("path"))
    a, b = files.select(F.col("file_id").alias("__a"), F.col("package").alias("own")), files.select(F.col("file_id").alias("__b"), "package", "number")
    edges = c["edges"].join(shuffled(a), F.col("src") == F.col("__a")).join(shuffled(b), F.col("dst") == F.col("__b"))
    name, way = F.concat(F.lit("f"), F.col("dst").cast("string")), (F.col("src") + F.col("dst")) % 4
    relative = F.concat(F.lit("../../"), "package", F.lit("/src/"), name, F.when(F.col("dst") % 5 == 1, F.lit(".js")).otherwise(F.lit("")))
    context = F.concat(F.lit("require.context('../../"), "package", F.lit("/src', false, /^\\.\\/"), name, F.lit("\\.ts$/);"))
    inside = F.concat(F.lit("@w/"), "package", F.when(F.col("number") % 2 == 0, "/s/").otherwise("/src/"), name)
    spec = F.when(way == 1, F.concat(F.lit("@/"), "package", F.lit("/src/"), name)).when(way == 2, inside).when((way == 3) & (F.col("own") == F.col("package")), F.concat(F.lit("#src/"), name)).otherwise(relative)
    said = lambda before, after: F.concat(F.lit(before), spec, F.lit(after))
    kind = F.col("kind")
    line = F.when(kind == "StaticImportType", said("import type { T } from '", "';")).when(kind == "DynamicImport", said("const later = import('", "');")).when(kind == "RequireContext", context).otherwise(said("import { a } from '", "';"))
    bodies = edges.groupBy(F.col("src").alias("__s")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    sources = files.join(shuffled(bodies), F.col("file_id") == F.col("__s"), "left").select(F.col("path").alias("rel_path"), F.concat_ws("\n", F.lit("// imports\n/* and exports */"), "body", F.lit(EXPORTED)).alias("text"))
    ends = files.groupBy("package", "number").agg(F.min("file_id").alias("least"), F.max("file_id").alias("most"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("file_id") % 5 == 0, F.format_string('"f%1$d": "./dist/esm/f%1$d.js"', "file_id")))), ", ").alias("bins"))
    main = F.when(F.col("package").isin("brand-2", "brand-3"), F.concat(F.lit(', "main": "./dist/esm/f'), "least", F.lit('.js"'))).otherwise("")
    script = F.when(F.col("package") == "brand-4", F.concat(F.lit(', "scripts": {"dev": "node --watch ./src/f'), "most", F.lit('.ts"}'))).otherwise("")
    exports = F.when(F.col("number") % 2 == 0, ', "exports": {"./s/*": {"import": "./src/*.ts"}}').otherwise("")
    # Exports make entry points of the files that they name; a pattern names none.
    text = F.concat(F.lit('{"name": "@w/'), "package", F.lit('", "imports": {"#src/*": "./src/*.ts"}'), main, script, exports, F.lit(', "bin": {'), "bins", F.lit("}}"))
    packages = ends.select(F.concat(F.lit("pkgs/"), "package", F.lit("/package.json")).alias("rel_path"), text.alias("text"))
    config = c.spark.createDataFrame([("package.json", '{"name": "all", "workspaces": ["pkgs/*"]}'), ("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["./pkgs/*"]}, /* one alias */}}')], "rel_path string, text string")
    return sources.unionByName(packages).unionByName(config)


def _scan(c: Canon) -> Scan:
    """A scan of the texts, which its steps read often and which are written once."""
    return Scan(Rounds(c.spark).table(texts(c)))


@query(_EDGES.rstrip(", ") + " SELECT src, dst, kind FROM x", _TABLES)
def scan_edges(c: Canon) -> DataFrame:
    return _scan(c).edges


@query(_PATHS + _ENTRIES.rstrip(", ") + " SELECT path, kind, profile FROM en", ("files",))
def scan_entries(c: Canon) -> DataFrame:
    return _scan(c).entries


@query(_EDGES + _ENTRIES + _REACHED.rstrip(", ") + """ SELECT path AS subject, CASE WHEN path IN (SELECT dst FROM x) THEN 'medium' ELSE 'high' END AS confidence
    FROM p WHERE path NOT IN (SELECT n FROM r)""", _TABLES)  # fmt: skip
def scan_unused_files(c: Canon) -> DataFrame:
    return _scan(c).unused_files().select("subject", "confidence")


# What is left of a reached file's exports, and how sure it is: types are low, targets of contexts medium, the others high if nothing asks for the file.
_EXPORTS = """n(name, kind) AS (VALUES ('a', 'StaticImportValue'), ('b', '-'), ('T', 'StaticImportType')),
    ux AS (SELECT CASE name WHEN 'T' THEN 'unused-type' ELSE 'unused-export' END AS code, concat(path, '#', name) AS subject,
        CASE WHEN name = 'T' THEN 'low' WHEN path IN (SELECT dst FROM x WHERE kind = 'RequireContext') THEN 'medium' WHEN path IN (SELECT dst FROM x WHERE src IN (SELECT n FROM r)) THEN 'medium' ELSE 'high' END AS confidence
      FROM p CROSS JOIN n WHERE path IN (SELECT n FROM r) AND path NOT IN (SELECT path FROM en)
        AND NOT EXISTS (SELECT 1 FROM x WHERE x.dst = path AND x.src IN (SELECT n FROM r) AND x.kind IN (n.kind, 'DynamicImport', 'RequireContext'))), """


@query(_EDGES + _ENTRIES + _REACHED + _EXPORTS.rstrip(", ") + " SELECT code, subject, confidence FROM ux", _TABLES)
def scan_unused_exports(c: Canon) -> DataFrame:
    return _scan(c).unused_exports().select("code", "subject", "confidence")


# Cycles: pairs that reach each other, and for each component the shortest walk from its least file back to it, of several the least. Walks of a
# component go on until one has come back, however long it is.
_CYCLES = """y AS (SELECT DISTINCT src, dst FROM x WHERE src <> dst), pr(a, b) AS (SELECT src, dst FROM y UNION SELECT pr.a, y.dst FROM pr JOIN y ON y.src = pr.b),
    sc AS (SELECT u.a AS node, min(u.b) AS c FROM pr u JOIN pr v ON u.a = v.b AND u.b = v.a GROUP BY u.a),
    ins AS (SELECT y.src, y.dst, s.c FROM y JOIN sc s ON s.node = y.src JOIN sc t ON t.node = y.dst AND t.c = s.c),
    wk(c, n, l, w) AS (SELECT c, c, 0, [c] FROM (SELECT DISTINCT c FROM sc) UNION ALL SELECT c, dst, l + 1, min(w) FROM (SELECT k.c, ins.dst, k.l, list_append(k.w, ins.dst) AS w
      FROM (SELECT *, bool_or(l > 0 AND n = c) OVER (PARTITION BY c) AS closed FROM wk) k JOIN ins ON ins.c = k.c AND ins.src = k.n WHERE NOT k.closed) GROUP BY c, dst, l),
    cy AS (SELECT array_to_string(arg_min(w, l), ' -> ') AS subject FROM wk WHERE n = c AND l > 0 GROUP BY c), """


@query(_EDGES + _ENTRIES + _REACHED + _EXPORTS + _CYCLES.rstrip(", ") + """ SELECT 'unused-file' AS code, path AS subject, CASE WHEN path IN (SELECT dst FROM x) THEN 'medium' ELSE 'high' END AS confidence, 'delete-file' AS remedy FROM p WHERE path NOT IN (SELECT n FROM r)
    UNION ALL SELECT code, subject, confidence, 'delete-export' FROM ux UNION ALL SELECT 'cycle', subject, 'high', 'break-cycle' FROM cy""", _TABLES)  # fmt: skip
def scan_findings(c: Canon) -> DataFrame:
    """A whole scan: every finding with its confidence and remedy, cycles included."""
    return _scan(c).findings.select("code", "subject", "confidence", "remedy")


@query(_PATHS + """k AS (SELECT DISTINCT package, CAST(regexp_extract(package, '([0-9]+)$', 1) AS INT) AS n FROM files),
    d AS (SELECT package, n, n % 5 = 0 AS dep, n % 2 = 0 AS cfg FROM k WHERE n % 5 = 0 OR n % 2 = 0)
    SELECT concat('pkgs/', package) AS root, CASE WHEN dep AND cfg THEN 'exact' ELSE 'heuristic' END AS confidence,
      (SELECT count(*) FROM files f WHERE f.package = d.package AND f.file_id % 3 = 0) + CASE WHEN cfg THEN 1 ELSE 0 END AS entries FROM d""", ("files",))  # fmt: skip
def framework_files(c: Canon) -> DataFrame:
    """Packages of every fifth number depend on a test framework, every second has its configuration; every third file is a test."""
    number = F.regexp_extract("package", r"(\d+)$", 1).cast("int")
    files = c["files"].select(F.concat(F.lit("pkgs/"), "package").alias("root"), number.alias("n"), "file_id")
    packages = files.select("root", "n").distinct()
    tests = files.select("root", F.concat(F.col("root"), F.lit("/src/f"), "file_id", F.when(F.col("file_id") % 3 == 0, ".test.ts").otherwise(".ts")).alias("rel_path"))
    sources = tests.unionByName(packages.where("n % 2 = 0").select("root", F.concat(F.col("root"), F.lit("/vitest.config.ts")).alias("rel_path")))
    dev = F.when(F.col("n") % 5 == 0, F.create_map(F.lit("vitest"), F.lit("1")))
    manifests = packages.select("root", F.lit(None).cast("map<string,string>").alias("dependencies"), dev.alias("devDependencies"))
    found = frameworks.detections(sources, manifests)
    entries = frameworks.framework_entries(found, sources).withColumn("root", F.regexp_extract("path", "^(pkgs/[^/]*)/", 1))
    return found.join(entries.groupBy("root").agg(F.count("*").alias("entries")), "root").select("root", "confidence", "entries")


# A pack, its dependency, a file that tells of it, an entry point of it, and what its dependency alone and the file alone mean.
_PACKED = [
    ("remix", "@remix-run/dev", "app/x.ts", "app/entry.server.tsx", "exact", None), ("nx", "nx", "nx.json", None, "heuristic", "heuristic"), ("turborepo", "turbo", "turbo.json", None, "heuristic", "heuristic"),
    ("angular", "@angular/core", "angular.json", "src/polyfills.ts", "heuristic", "heuristic"), ("rspack", "@rspack/core", "rspack.config.cjs", "src/index.tsx", "heuristic", "heuristic"),
    ("rsbuild", "@rsbuild/core", "rsbuild.config.mts", "src/index.js", "heuristic", "heuristic"), ("rollup", "rollup", "rollup.config.ts", "src/index.ts", "heuristic", "heuristic"),
    ("gatsby", "gatsby", "gatsby-config.js", "gatsby-node.mjs", "heuristic", "heuristic"), ("playwright", "@playwright/test", "playwright.config.ts", "e2e/a/b.spec.ts", "heuristic", "heuristic"),
    ("cypress", "cypress", "cypress.config.js", "cypress/e2e/a/b.ts", "heuristic", "heuristic"), ("vitepress", "vitepress", ".vitepress/config.ts", ".vitepress/theme/a/b.vue", "heuristic", "heuristic"),
    ("docusaurus", "@docusaurus/core", "docusaurus.config.js", "src/theme/a/b.tsx", "heuristic", "heuristic"), ("trigger-dev", "@trigger.dev/sdk", "trigger.config.mts", "trigger/a/b.ts", "heuristic", "heuristic"),
    ("file-routing", "expo-router", "app/routes/a.tsx", "src/router.js", "exact", None),
]


def _pick(i: int) -> str:
    return f"CASE p_size % {len(_PACKED)} " + " ".join(f"WHEN {k} THEN " + ("NULL" if row[i] is None else f"'{row[i]}'") for k, row in enumerate(_PACKED)) + " END"


# Every file is a workspace: its dependency by one digit of its number, its configuration by another; the entry point is always there.
_WORKSPACES = f"""SELECT concat('w/f', file_id) AS root, {_pick(0)} AS framework, {_pick(1)} AS dep, {_pick(2)} AS config, {_pick(3)} AS entry, {_pick(4)} AS by_dep, {_pick(5)} AS by_config,
    file_id % 3 <> 0 AS has_dep, file_id % 2 = 0 AS has_config FROM"""


@query(f"""w AS ({_WORKSPACES} files), d AS (SELECT *, CASE WHEN has_dep AND has_config THEN 'exact' WHEN has_dep THEN by_dep WHEN has_config THEN by_config END AS confidence FROM w)
    SELECT root, framework, confidence, array_to_string(list_sort([f FOR f IN [entry, CASE WHEN has_config AND framework NOT IN ('nx', 'turborepo', 'angular', 'remix') THEN config END] IF f IS NOT NULL]), ' ') AS entries FROM d WHERE confidence IS NOT NULL""", ("files",))  # fmt: skip
def framework_packs(c: Canon) -> DataFrame:
    """Workspaces by pack, found by a dependency, a configuration or both, with the entry points that the pack brings."""
    rows = c.spark.sql(_WORKSPACES + " {files}", files=c["files"])
    files = rows.select("root", F.explode(F.array_compact(F.array("entry", F.when(F.col("has_config"), F.col("config"))))).alias("file")).select("root", F.concat_ws("/", "root", "file").alias("rel_path"))
    maps = F.when(F.col("has_dep"), F.create_map("dep", F.lit("1")))
    found = frameworks.detections(files, rows.select("root", F.lit(None).cast("map<string,string>").alias("dependencies"), maps.alias("devDependencies")))
    brought = frameworks.framework_entries(found, files).select(F.regexp_extract("path", "^w/[^/]+", 0).alias("root"), "framework", F.regexp_replace("path", "^w/[^/]+/", "").alias("file"))
    return found.join(brought, ["root", "framework"], "left").groupBy("root", "framework", "confidence").agg(F.array_join(F.array_sort(F.collect_set("file")), " ").alias("entries"))


@query(_OWNED + "z AS (SELECT split_part(rel_path, '/', 1) AS directory, count(*) AS files FROM owned WHERE owner IS NULL AND contains(rel_path, '/') GROUP BY 1 HAVING count(*) >= 3) SELECT * FROM z", ("files",))
def unowned_directories(c: Canon) -> DataFrame:
    return governance.unowned_directories(_owned(c))


@query(_FOUND + """z AS (SELECT code, count(*) AS findings, count(*) FILTER (confidence = 'high' AND severity <> 'info') AS blocking, arg_min(subject, id) AS first FROM found GROUP BY code)
    SELECT code, findings, blocking, CASE WHEN blocking > 0 THEN concat('Settle ', blocking, ' of ', findings, ' ', code, ' findings before merging, for instance `', first, '`.')
      ELSE concat('Look at ', findings, ' ', code, ' findings, for instance `', first, '`.') END AS text FROM z""", ("files", "edges"))  # fmt: skip
def review_advice(c: Canon) -> DataFrame:
    return report.advice(_found(c))
