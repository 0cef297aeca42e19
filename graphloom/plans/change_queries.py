"""Queries of what changes and configures a repository: maintained reachability, stored facts, ignore files, configurations of tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import adapters, graph, incremental
from graphloom.operators.tables import Rounds
from graphloom.plans.queries import query, seeds
from graphloom.plans.scan_queries import texts
from graphloom.sources.extract import extracted
from graphloom.sources.ignore import ignore_rules, ignored
from graphloom.sources.projections import Canon
from graphloom.streaming.debounce import GENERATIONS, rebuild_when_quiet

_RT = ("files", "edges")


@query("""ne AS (SELECT src, dst FROM edges WHERE src % 13 <> 0 UNION SELECT dst, src FROM edges WHERE src % 13 = 0),
    r(n) AS (SELECT file_id FROM entries WHERE file_id % 11 <> 0 UNION SELECT ne.dst FROM r JOIN ne ON ne.src = r.n) SELECT n AS node FROM r""", ("edges", "entries"))  # fmt: skip
def delta_reachable(c: Canon) -> DataFrame:
    """Every thirteenth file turns its imports round and every eleventh entry point goes: maintained from what was reached before; the SQL rebuilds."""
    rounds = Rounds(c.spark)
    old = rounds.table(c["edges"].select("src", "dst"))
    turned = F.col("src") % 13 == 0
    new = old.where(~turned).unionByName(old.where(turned).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    before = seeds(c)
    reached = rounds.table(graph.reach(old, before).select("node"))
    return incremental.reached_after(old, rounds.table(new), before, before.where("node % 11 <> 0"), reached)


@query("""p AS (SELECT count(*) AS n, count(*) FILTER (file_id % 13 = 0) AS m FROM files), e AS (SELECT count(*) AS k FROM edges)
    SELECT 1 AS run, n AS texts_read, k AS specifiers FROM p CROSS JOIN e UNION ALL SELECT 2, m, k + m FROM p CROSS JOIN e UNION ALL SELECT 3, 0, k + m FROM p CROSS JOIN e""", _RT)  # fmt: skip
def fact_store(c: Canon) -> DataFrame:
    """Facts of all sources, again after every thirteenth has one import more, and again unchanged: texts read in each run, and specifiers found."""
    rounds = Rounds(c.spark)
    first = rounds.table(texts(c).where("rel_path like '%.ts'"))
    changed = F.regexp_extract("rel_path", r"/f(\d+)[.]ts$", 1).cast("int") % 13 == 0
    second = first.withColumn("text", F.when(changed, F.concat("text", F.lit("\nimport './more';"))).otherwise(F.col("text")))
    out = []
    for run, sources in enumerate((first, second, second), 1):
        facts, n = incremental.stored_facts(sources, f"{rounds.root}/store", extracted)
        out.append(facts.agg(F.lit(run).alias("run"), F.lit(n).cast("long").alias("texts_read"), F.count("specifier").alias("specifiers")))
    return out[0].unionByName(out[1]).unionByName(out[2])


IGNORES = {".gitignore": "generated/\n*.config.ts\n\n# but not these\n!small/src/**\n", "promo/.gitignore": "/src/brand-1/\n!*.config.ts\n", "large/src/.gitignore": "*\n!*.d.ts\n"}


@query("""SELECT rel_path FROM files WHERE contains(rel_path, '/generated/') OR starts_with(rel_path, 'promo/src/brand-1/') OR starts_with(rel_path, 'large/src/')
    OR (ends_with(rel_path, '.config.ts') AND NOT starts_with(rel_path, 'small/src/') AND NOT starts_with(rel_path, 'promo/'))""", ("files",))  # fmt: skip
def ignored_paths(c: Canon) -> DataFrame:
    """Files that ignore files at three depths take out: the deepest rule wins, and a folder that is out brings nothing back."""
    return ignored(c["files"].select("rel_path"), ignore_rules(c.spark.createDataFrame(list(IGNORES.items()), "rel_path string, text string")))


@query("""k AS (SELECT package, min(file_id) AS lo, max(file_id) AS hi, CAST(regexp_extract(package, '([0-9]+)$', 1) AS INT) % 2 = 0 AS even FROM files GROUP BY package)
    SELECT concat('pkgs/', package) AS root, 'jest' AS tool, 'setup' AS kind, concat('./src/f', lo, '.ts') AS value FROM k UNION ALL SELECT concat('pkgs/', package), 'babel', 'package', concat('preset-', hi) FROM k
    UNION ALL SELECT concat('pkgs/', package), 'tsup', 'entry', concat('src/f', hi, '.ts') FROM k WHERE even UNION ALL SELECT concat('pkgs/', k.package), 'mocha', 'test', concat('src/f', file_id, '.ts') FROM files JOIN k USING (package) WHERE even AND file_id % 10 = 0""", ("files",))  # fmt: skip
def config_adapters(c: Canon) -> DataFrame:
    """What the configurations of each package's tools name; every second package has two tools more."""
    even = F.regexp_extract("package", r"(\d+)$", 1).cast("int") % 2 == 0
    file = F.concat(F.lit("src/f"), F.col("file_id").cast("string"), F.lit(".ts"))
    own = c["files"].groupBy("package").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"), F.collect_list(F.when(F.col("file_id") % 10 == 0, file)).alias("tests"))
    jest = F.struct(F.array(F.format_string("./src/f%d.ts", "lo")).alias("setupFiles"))
    babel = F.struct(F.array(F.array(F.format_string("preset-%d", "hi"))).alias("presets"))
    tsup = F.when(even, F.struct(F.array(F.format_string("src/f%d.ts", "hi")).alias("entry")))
    root = F.concat(F.lit("pkgs/"), "package")
    manifest = own.select(F.concat(root, F.lit("/package.json")).alias("rel_path"), F.to_json(F.struct(jest.alias("jest"), babel.alias("babel"), tsup.alias("tsup"))).alias("text"))
    mocha = own.where(even).select(F.concat(root, F.lit("/.mocharc.json")).alias("rel_path"), F.concat(F.lit("// tests\n"), F.to_json(F.struct(F.col("tests").alias("spec")))).alias("text"))
    return adapters.config_inputs(manifest.unionByName(mocha)).select("root", "tool", "kind", "value")


@query("""SELECT root, generation, started, ended, paths FROM (
      SELECT root, generation, min(m) AS started, max(m) AS ended, count(DISTINCT event_type) AS paths, max(now) AS now FROM (
        SELECT *, CAST(sum(begins) OVER (PARTITION BY root ORDER BY m) AS BIGINT) AS generation FROM (
          SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY root ORDER BY m) < 1200000000 THEN 0 ELSE 1 END AS begins, max(m // 1000) OVER () - 3600000 AS now
          FROM (SELECT concat('repo-', user_id % 7) AS root, event_type, epoch_us(ts) AS m FROM events WHERE event_type <> 'purchase'))) GROUP BY root, generation)
    WHERE (ended + 999) // 1000 + 1200000 <= now""")  # fmt: skip
def change_generations(c: Canon) -> DataFrame:
    """Events as a stream of changes of seven repositories: those that twenty quiet minutes have ended, as generations; an hour may be out of order."""
    names = {"error": "a/package.json", "click": "tsconfig.base.json", "view": "src/a.ts", "signup": "CODEOWNERS", "purchase": "notes.txt"}
    path = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    events = c.spark.readStream.schema(c.read("events").schema).parquet(f"{c.sf_dir}/events*.parquet")
    # Micros since 1970, whatever zone the session has.
    at = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)))")
    changes = events.select(F.concat(F.lit("repo-"), (F.col("user_id") % 7).cast("string")).alias("root"), path.alias("path"), at.alias("ts"))
    root = Rounds(c.spark).root
    rebuild_when_quiet(changes, lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/generations/batch={n}"), f"{root}/stream", quiet_ms=1_200_000, late="1 hour").awaitTermination()
    rows = c.spark.read.schema(GENERATIONS).parquet(f"{root}/generations")
    return rows.groupBy("root", "generation", "started", "ended").agg(F.countDistinct("path").alias("paths"))
