"""Edges are computed once for what is made of them, and roles by more tasks than read a small table."""

from graphloom.plans import queries
from graphloom.sources.projections import Canon


def test_demand_reads_written_edges(spark):
    c = Canon(spark, "/root/testdata/sf0.001")
    assert "Window" in c["edges"]._jdf.queryExecution().optimizedPlan().toString()
    queries._written(c, "edges")
    for name in ("edges", "imports", "reexports"):
        assert "Window" not in c[name]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in queries.roled_files(c)._jdf.queryExecution().optimizedPlan().toString()
