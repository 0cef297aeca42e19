"""Scans without a bound: all files that a glob or context fits, and cycles of any length."""

import duckdb

from graphloom.plans import scan_queries
from graphloom.plans.scan import Scan


def test_globs_and_contexts_of_many_files(spark):
    many = [f"src/parts/f{i}.ts" for i in range(620)]
    files = {"package.json": '{"name": "app"}', "src/index.ts": "const a = import.meta.glob('./parts/*.ts');", "src/main.ts": "const b = require.context('./parts', false, /\\.ts$/);", **dict.fromkeys(many, "")}
    rows = spark.createDataFrame(sorted(files.items()), "rel_path string, text string")
    met = {(r["src"], r["dst_file"]) for r in Scan(rows).expanded.collect()}
    assert met == {(src, f) for src in ("src/index.ts", "src/main.ts") for f in many}
    assert Scan(rows, glob_cap=500).expanded.count() == 1000


def test_long_cycles():
    ring = lambda name, n: [(f"{name}{i:02}", f"{name}{(i + 1) % n:02}") for i in range(n)]
    edges = [*ring("a", 2), *ring("b", 30), *ring("c", 61), ("b00", "b05"), ("c60", "c58"), ("a00", "b00")]  # a shorter way round, a circle off the least node, a way that leads off
    values = ", ".join(f"('{a}', '{b}', 'k')" for a, b in edges)
    cycles = f"WITH RECURSIVE x(src, dst, kind) AS (VALUES {values}), {scan_queries._CYCLES.rstrip(', ')} SELECT subject FROM cy"
    told = {s for (s,) in duckdb.connect().execute(cycles).fetchall()}
    shown = lambda name, at: " -> ".join(f"{name}{i:02}" for i in [*at, 0])
    assert told == {shown("a", range(2)), shown("b", [0, *range(5, 30)]), shown("c", range(61))}
