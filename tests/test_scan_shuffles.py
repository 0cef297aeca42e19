"""Joins of a scan whose sides grow with the files: nothing of them is broadcast, as that would go through the driver."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analyzers, liveness, resolve
from graphloom.operators.tables import Rounds
from graphloom.plans import scan_queries
from graphloom.sources import config
from graphloom.sources.projections import Canon

SF = "/root/testdata/sf0.001"


def broadcasts(table):
    """How many broadcasts the plan has before it runs; what it estimates as small is sent whole."""
    return table._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(p,) for p in ["a.ts", "a.js", "b/index.ts", "b.d.ts", "x/.ts", "c.js.ts", "c.jsx", "d.mts", ".ts", "e.vue", "f", "g.js.js"]], "rel_path string")


def test_bases_of_probes(spark, files):
    bases = ["a", "a.ts", "a.js", "a.jsx", "b", "b.d", "b.d.ts", "x/", "c.js", "c", "c.jsx", "d.mjs", "", "e", "f", "g.js", "h"]
    rows = spark.createDataFrame([(b,) for b in bases], "base string")
    probed = rows.select("base", resolve.probes(rows["base"]).alias("probes")).collect()
    paths = [r["rel_path"] for r in files.collect()]
    met = {(r["rel_path"], b) for r in files.select("rel_path", resolve.probed_by(files["rel_path"]).alias("bases")).collect() for b in r["bases"]}
    assert {(p, r["base"]) for r in probed for p in paths if p in r["probes"]} == {(p, b) for p, b in met if b in bases}


def test_texts_and_contexts(spark, files):
    assert broadcasts(scan_queries.texts(Canon(spark, SF))) == 0
    asked = spark.createDataFrame([("b", True, "^x")], "base string, deep boolean, regex string")
    assert broadcasts(config.begun(config.headed(asked), files, F.col("path"))) == 0


def test_unused_files(spark, files):
    written = Rounds(spark).table  # of written tables Spark knows how small they are
    rows = written(files.selectExpr("rel_path", "rel_path AS file_id", "'source' AS role", "'' AS directory"))
    pressure = written(spark.createDataFrame([("a.ts", 1, 1)], "file_id string, unresolved long, resolved long"))
    edges, reached = written(spark.createDataFrame([("a.ts", "f")], "src string, dst string")), written(spark.createDataFrame([("f",)], "node string"))
    assert broadcasts(analyzers.unused_files(rows, reached, edges, pressure)) == 1  # one row


def test_live_exports(spark):
    written = Rounds(spark).table
    exports = written(spark.createDataFrame([("f", "a", False)], "file string, name string, is_type boolean"))
    assert broadcasts(liveness.live_exports(exports, written(spark.createDataFrame([("f", "a")], "file string, name string")))) == 0


def test_unused_packages(spark):
    written = Rounds(spark).table
    files = written(spark.createDataFrame([("f", "p")], "file_id string, package string"))
    assert broadcasts(analyzers.unused_packages(files, written(spark.createDataFrame([("f",)], "node string")))) == 0
