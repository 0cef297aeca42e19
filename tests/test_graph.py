import random

from graphloom.operators import graph, liveness, rules
from graphloom.streaming.watch import rebuild_on_change


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_reach_components_and_proofs(spark):
    edges = frame(spark, [(1, 2), (2, 3), (3, 2), (3, 4), (5, 6), (6, 7), (7, 5), (8, 8)], "src long, dst long")
    seeds = frame(spark, [(1,)], "node long")
    assert {(r["node"], r["hop"]) for r in graph.reach(edges, seeds).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {(r["node"], r["component"]) for r in graph.strong_components(edges).collect()} == {(2, 2), (3, 2), (5, 5), (6, 5), (7, 5)}
    chains = graph.cycle_chains(edges, graph.strong_components(edges)).collect()
    assert {tuple(r["chain"]) for r in chains} == {(2, 3, 2), (5, 6, 7, 5)}
    assert {(r["node"], tuple(r["path"])) for r in graph.shortest_proofs(edges, seeds).collect()} >= {(4, (1, 2, 3, 4))}
    assert graph.reach(edges.limit(0), seeds).count() == 1
    assert graph.closure(edges.limit(0)).count() == 0


def test_star_reexports(spark):
    imports = frame(spark, [("main", "index", "used", False)], "importer string, source string, name string, is_type boolean")
    reexports = frame(spark, [("index", "leaf", "*", "*", True, False)], "reexporter string, source string, original string, exported string, is_star boolean, is_type boolean")
    reached = frame(spark, [("main",), ("index",), ("leaf",)], "file string")
    wanted = liveness.demand(imports, reexports, reached, None)
    exports = frame(spark, [("leaf", "used", False), ("leaf", "unused", False)], "file string, name string, is_type boolean")
    assert [r["name"] for r in liveness.live_exports(exports, wanted).collect()] == ["used"]


def test_rules(spark):
    edges = frame(spark, [("i", "app", "StaticImportValue"), ("app", "secret", "DynamicImport")], "src string, dst string, kind string")
    contexts = frame(spark, [("i", "src/index.ts", None, None, []), ("app", "src/app.ts", None, None, []), ("secret", "src/internal/secret.ts", None, None, [])], "node string, path string, workspace string, package string, tags array<string>")
    found = rules.violations(edges, contexts, [rules.Forbidden("no-internal", rules.End(path=("src/app.ts",)), rules.End(path=("src/internal/**",))), rules.Forbidden("from", rules.End(reachable_from=("src/index.ts",)), rules.End(kinds=("dynamic",))), rules.Forbidden("ws", rules.End(workspace=("x",)))])
    assert {(r["rule"], r["subject"]) for r in found.collect()} == {("no-internal", "src/app.ts -> src/internal/secret.ts"), ("from", "src/app.ts -> src/internal/secret.ts")}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("package.json\nsrc/a.ts\nsrc/a.ts\nnotes.bin\n")
    seen = []
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "path")
    rebuild_on_change(stream, lambda rows, n: seen.append((n, sorted(map(tuple, rows.collect())))), str(tmp_path / "c")).awaitTermination()
    assert seen == [(0, [("package.json", "manifest"), ("src/a.ts", "source")])]


def by_force(edges, seeds):
    """Hops and least shortest paths from the seeds."""
    best = {s: (s,) for s in seeds}
    level = dict(best)
    while level:
        ahead = {}
        for n, path in level.items():
            for a, b in edges:
                if a == n and b not in best and (b not in ahead or (*path, b) < ahead[b]):
                    ahead[b] = (*path, b)
        best |= ahead
        level = ahead
    return best


def test_fixpoints_by_force(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(41, 0)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (5, 6)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    starts = [0, 50]
    want = by_force(pairs, starts)
    seeds = spark.createDataFrame([(s,) for s in starts], "node long")
    reached = {n: set(by_force(pairs, [n])) for n in range(60)}
    ends = {b: set().union(*(reached[y] for x, y in pairs if x == b)) for b in {a for a, _ in pairs}}
    for steps, parts in ((1, 2), (3, 4), (10, 4)):
        monkeypatch.setattr(graph, "STEPS_OF_FEW", steps)
        monkeypatch.setattr(graph, "PARTS", parts)
        assert {r["node"]: r["hop"] for r in graph.reach(edges, seeds).collect()} == {n: len(p) - 1 for n, p in want.items()}
        assert {r["node"] for r in graph.reach(edges, seeds, max_hops=4).collect()} == {n for n, p in want.items() if len(p) <= 5}
        assert {r["node"]: tuple(r["path"]) for r in graph.shortest_proofs(edges, seeds).collect()} == want
    labelled = spark.createDataFrame([(f"l{n}", n) for n in range(60)] + [(None, 3), ("l3", 3), ("two", 1), ("two", 50)], "label string, node long").repartition(3)
    got = {(r["label"], r["node"]) for r in graph.reach_sets(edges, labelled).collect()}
    assert got == {(f"l{n}", m) for n in range(60) for m in reached[n]} | {(None, m) for m in reached[3]} | {("two", m) for m in reached[1] | reached[50]}
    assert {(r["a"], r["b"]) for r in graph.closure(edges).collect()} == {(a, b) for a, found in ends.items() for b in found}
    mutual = {n: {m for m in found if n in ends.get(m, ())} for n, found in ends.items()}
    components = {(n, min(found)) for n, found in mutual.items() if len(found) > 1}
    for few in (4096, 0):  # through pairs, and by colours
        assert {(r["node"], r["component"]) for r in graph.strong_components(edges, few=few).collect()} == components
    assert len(components) > 20
