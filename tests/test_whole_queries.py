"""Queries over small tables whose answers a cut would change."""

from graphloom.plans import queries


def tables(spark, edges, entries, packages):
    """Tables with import edges (src, dst), entry files and files (file_id, package)."""
    return {
        "edges": spark.createDataFrame([(a, b, "StaticImportValue") for a, b in edges], "src long, dst long, kind string"),
        "entries": spark.createDataFrame([(n, "main", "production") for n in entries], "file_id long, kind string, profile string"),
        "files": spark.createDataFrame([(n, p, "w", f"{p}/{n}.ts", 1) for n, p in packages], "file_id long, package string, workspace string, rel_path string, p_size int"),
    }


def test_unused_packages(spark):
    c = tables(spark, [(1, 2), (2, 3), (5, 4)], [1], [(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c")])
    assert [tuple(r) for r in queries.unused_packages(c).select("package", "files").collect()] == [("c-1", 2)]  # the query parts packages by size


def test_shortest_proof(spark):
    edges = [*((k, k + 1) for k in range(1, 20)), (3, 30), (30, 5), (4, 2), (19, 1), (50, 51)]
    found, front = {1: (1,)}, [1]
    while front:  # breadth first; a node's least path comes from the least path before it
        paths = [(*found[a], b) for a in front for x, b in edges if x == a and b not in found]
        front = sorted({p[-1] for p in paths})
        found |= {n: min(p for p in paths if p[-1] == n) for n in front}
    got = {r["node"]: (r["hop"], r["path"]) for r in queries.shortest_proof(tables(spark, edges, [1], [])).collect()}
    assert got == {n: (len(p) - 1, ">".join(map(str, p))) for n, p in found.items() if n != 1} and max(h for h, _ in got.values()) > 12


def test_layer_rules(spark):
    files = [(k, p) for k, p in enumerate("abcdef", 1)]
    got = lambda edges: sorted(tuple(r) for r in queries.layer_rules(tables(spark, edges, [], files)).select("top", "leaves").collect())
    assert got([(1, 2), (2, 3), (4, 3), (5, 6), (6, 5)]) == [("a-1", "c-1"), ("d-1", "c-1")]
    assert got([(1, 2), (4, 3)]) == []  # two workspaces import
