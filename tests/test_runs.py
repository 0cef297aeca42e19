"""Long lines of nodes are searched as one node, and what grows with the graph is not broadcast in the rounds."""

from graphloom.operators import analyzers, graph, incremental, rules
from graphloom.operators.tables import Rounds


def counting(monkeypatch):
    written, counted = [], Rounds.counted
    monkeypatch.setattr(Rounds, "counted", lambda self, df, count=None: (written.append(df), counted(self, df, count))[1])
    return written


def lines(spark):
    """A line of 120 that leads into a ring of 60 whose nodes have no other way, one that leaves it and comes back, a ring of its own, and loops."""
    line = [(k, k + 1) for k in range(120)] + [(k, k + 1) for k in range(120, 180)] + [(180, 120), (150, 150), (7, 7)]
    pairs = [*line, *[(k, k + 1) for k in range(300, 330)], (330, 300)]
    return pairs, spark.createDataFrame(pairs * 2, "src long, dst long")


def test_closure_of_long_lines(spark, monkeypatch):
    pairs, edges = lines(spark)
    monkeypatch.setattr(graph, "BLOCK", 16)
    written = counting(monkeypatch)
    got = [(r["a"], r["b"]) for r in graph.closure(edges).collect()]
    behind = lambda n: {*range(n + 1, 181), *([7] if n == 7 else [])} if n < 120 else set(range(120, 181)) if n < 300 else set(range(300, 331))
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, _ in pairs for b in behind(a)}
    assert len(written) < 25  # a write for every third step without runs


def test_components_of_long_lines(spark, monkeypatch):
    _, edges = lines(spark)
    written = counting(monkeypatch)
    got = {(r["node"], r["component"]) for r in graph.strong_components(edges).collect()}
    assert got == {(n, 120) for n in range(120, 181)} | {(n, 300) for n in range(300, 331)}
    assert len(written) < 25


def broadcast(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def small(spark):
    """Written tables of a few rows, which Spark would broadcast."""
    rounds = Rounds(spark)
    edges = rounds.table(spark.createDataFrame([(k, k + 1, "StaticImportValue") for k in range(12)], "src long, dst long, kind string"))
    files = rounds.table(spark.createDataFrame([(k, f"src/{k}.ts", "w", f"p{k % 2}") for k in range(13)], "file_id long, rel_path string, workspace string, package string"))
    return edges, files


def test_maintained_reachability_without_broadcasts(spark, monkeypatch):
    edges, files = small(spark)
    node = files.selectExpr("file_id as node")
    written = counting(monkeypatch)
    got = incremental.reached_after(edges, edges.where("src <> 6"), node.where("node = 0"), node.where("node = 0"), node)
    assert {r["node"] for r in got.collect()} == set(range(7))
    assert written and not [df for df in written if broadcast(df)]


def test_rules_without_broadcasts(spark):
    edges, files = small(spark)
    contexts = files.selectExpr("file_id as node", "rel_path as path", "workspace", "package")
    for end, want in ((rules.End(reachable_from=("src/9.ts",)), {9, 10, 11}), (rules.End(reaches=("src/2.ts",)), {0, 1, 2})):
        found = rules.violations(edges, contexts, [rules.Forbidden("r", end)])
        assert {r["src"] for r in found.collect()} == want
        # The labels of a search are few; nothing else is sent round.
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 2


def test_impact_without_broadcasts(spark):
    _, files = small(spark)
    reached = files.selectExpr("file_id % 3 as target", "file_id as node")
    found = analyzers.impact(reached, files, files.selectExpr("file_id", "'main' as kind").where("file_id < 2"))
    assert {tuple(r) for r in found.collect()} == {(0, 5, "p0,p1", "main"), (1, 4, "p0,p1", "main"), (2, 4, "p0,p1", "")}
    assert not broadcast(found)
