"""The test tables as a repository graph: canonical tables as SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
CANON = {
    # Parts are files: brand is the package, type the workspace.
    "files": """
        SELECT p_partkey AS file_id, lower(p_type) AS workspace, lower(replace(p_brand, '#', '-')) AS package,
          concat(lower(p_type), '/', CASE p_size % 10 WHEN 0 THEN '__tests__' WHEN 1 THEN 'fixtures' WHEN 2 THEN 'examples' WHEN 3 THEN 'generated' ELSE 'src' END, '/',
            lower(replace(p_brand, '#', '-')), '/f', p_partkey, CASE p_size % 7 WHEN 0 THEN '.stories.tsx' WHEN 1 THEN '.config.ts' WHEN 2 THEN '.d.ts' ELSE '.ts' END) AS rel_path,
          p_size FROM part""",
    # Edges are consecutive returned lines of an order.
    "edges": f"""
        SELECT l_partkey AS src, nx AS dst, CASE WHEN min(l_tax) < 0.02 THEN 'StaticImportType' WHEN min(l_tax) < 0.04 THEN 'DynamicImport' WHEN min(l_tax) < 0.06 THEN 'RequireContext' ELSE 'StaticImportValue' END AS kind
        FROM (SELECT *, lead(l_partkey) OVER w AS nx, lead(l_returnflag) OVER w AS nf, lead(l_quantity) OVER w AS nq FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER})) t
        WHERE nx IS NOT NULL AND nx <> l_partkey AND l_returnflag = 'R' AND nf = 'R' AND l_quantity >= 25 AND nq >= 25 GROUP BY l_partkey, nx""",
    "entries": """
        SELECT p_partkey AS file_id, CASE p_size % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'development' ELSE 'both' END AS profile,
          CASE p_size % 4 WHEN 0 THEN 'package-main' WHEN 1 THEN 'package-bin' WHEN 2 THEN 'framework-pack' ELSE 'explicit-config' END AS kind
        FROM part WHERE p_brand IN ('Brand#2', 'Brand#3')""",
    "pressure": """
        SELECT l_partkey AS file_id, CAST(sum(CASE WHEN l_returnflag = 'A' AND l_quantity < 6 THEN 1 ELSE 0 END) AS BIGINT) AS unresolved,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS resolved FROM lineitem GROUP BY l_partkey""",
    # Users follow each other in errors; days bound the window's partitions.
    "user_edges": """
        SELECT DISTINCT user_id AS src, nu AS dst FROM (SELECT *, lead(user_id) OVER w AS nu, lead(event_type) OVER w AS nt FROM events WINDOW w AS (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id)) t
        WHERE nu <> user_id AND event_type = 'error' AND nt = 'error' AND value >= 40""",
    "declared": """
        SELECT DISTINCT concat('nation-', s_nationkey) AS workspace, lower(replace(p_brand, '#', '-')) AS dep, CASE l_linestatus WHEN 'F' THEN 'dependency' ELSE 'dev dependency' END AS dep_kind
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N' AND l_quantity >= 49""",
    "used": """
        SELECT DISTINCT concat('nation-', s_nationkey) AS workspace, CASE WHEN p_size % 5 = 0 THEN concat('Brand', p_size) ELSE lower(replace(p_brand, '#', '-')) END AS dep
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity <= 2""",
    # Every file exports a and b as values and T as a type; edges import one of them, or all; every third edge re-exports.
    "exports": "SELECT p_partkey AS file, n.name, n.is_type FROM part CROSS JOIN (VALUES ('a', false), ('b', false), ('T', true)) AS n(name, is_type)",
    "imports": "SELECT src AS importer, dst AS source, CASE (src + dst) % 5 WHEN 0 THEN '*' WHEN 1 THEN 'T' WHEN 2 THEN 'b' ELSE 'a' END AS name, (src + dst) % 5 = 1 AS is_type FROM edges",
    "reexports": """
        SELECT src AS reexporter, dst AS source, CASE (src + dst) % 3 WHEN 0 THEN '*' ELSE 'a' END AS original, CASE (src + dst) % 3 WHEN 0 THEN '*' WHEN 1 THEN 'a' ELSE 'b' END AS exported,
          (src + dst) % 3 = 0 AS is_star, false AS is_type FROM edges WHERE kind <> 'DynamicImport'""",
    "members": "SELECT DISTINCT l_partkey AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS parent, concat('m', l_linenumber) AS member FROM lineitem WHERE l_quantity >= 30",
    "member_refs": """
        SELECT DISTINCT l_partkey AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS parent, concat('m', l_linenumber) AS member, CASE l_returnflag WHEN 'A' THEN 'write' ELSE 'read' END AS access
        FROM lineitem WHERE l_quantity >= 44""",
    # Regions own nations, nations customers and suppliers: a hierarchy whose edges depend upwards.
    "hierarchy": """
        SELECT concat('customer:', c_custkey) AS src, concat('nation:', c_nationkey) AS dst FROM customer UNION ALL SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey) FROM supplier
        UNION ALL SELECT concat('nation:', n_nationkey), concat('region:', n_regionkey) FROM nation""",
    "parity": """
        SELECT p_partkey AS case_id, lower(p_type) AS family, CASE p_size % 3 WHEN 0 THEN 'tool-a' WHEN 1 THEN 'tool-b' ELSE 'tool-c' END AS tool, p_size % 10 < 8 AS ok FROM part""",
}
_NEEDS = {"imports": ("edges",), "reexports": ("edges",)}


class Canon:
    """Canonical tables of a test folder; each is planned when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            sql = CANON[name]
            frames = {t: self.read(t) for t in TABLES if t in sql.replace(",", " ").split()} | {n: self[n] for n in _NEEDS.get(name, ())}
            words = [f"{{{w}}}" if w in frames and before in ("FROM", "JOIN") else w for before, w in _with_last(_spaced(sql))]
            self.made[name] = self.spark.sql(" ".join(words), **frames)
        return self.made[name]


def _spaced(sql: str) -> list[str]:
    return sql.replace("(SELECT", "( SELECT").replace(") t", " ) t").split()


def _with_last(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(["", *words], words, strict=False))


def with_tables(*names: str) -> str:
    """The WITH list of canonical tables (and what they need) for SQL."""
    done: dict[str, str] = {}
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            done[n] = CANON[n]
    return ", ".join(f"{n} AS ({sql})" for n, sql in done.items())
