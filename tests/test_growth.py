"""What must not grow with the files or changes: plans take folders apart, not files, and the state is told a path once."""

import pandas as pd

from graphloom.sources.ignore import ignore_rules, ignored
from graphloom.sources.repo import inventory
from graphloom.streaming import debounce

PATHS = ["a/x.ts", "a/b/y.ts", "a/b/c/z.log", "d/e.ts", "top.ts", "a/b/c/w.ts"]


def generators(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate " in line]


def test_workspaces_by_folder(spark):
    files = spark.createDataFrame([(p,) for p in PATHS], "rel_path string")
    found = inventory(files, spark.createDataFrame([("a", "A"), ("a/b", "B"), ("d/e.ts", "no")], "root string, workspace string"))
    assert {(r["rel_path"], r["workspace"]) for r in found.collect()} == {("a/x.ts", "A"), ("a/b/y.ts", "B"), ("a/b/c/z.log", "B"), ("a/b/c/w.ts", "B"), ("d/e.ts", None), ("top.ts", None)}
    assert generators(found) and not [g for g in generators(found) if "rel_path" in g]


def test_ignored_by_folder(spark):
    files = spark.createDataFrame([(p,) for p in PATHS * 2], "rel_path string")
    rules = ignore_rules(spark.createDataFrame([(".gitignore", "d/\n*.log\n/top.ts"), ("a/b/.gitignore", "*.ts\n!w.ts")], "rel_path string, text string"))
    out = ignored(files, rules)
    assert sorted(r["rel_path"] for r in out.collect()) == ["a/b/c/z.log", "a/b/y.ts", "d/e.ts", "top.ts"]
    assert generators(out) and not [g for g in generators(out) if "rel_path" in g]


class Calls:
    """State kept in a dictionary, with the number of writes."""

    def __init__(self):
        self.rows, self.writes = {}, 0

    def updateValue(self, key, value):
        self.rows[key] = value
        self.writes += 1

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]


def test_store_is_told_a_path_of_a_slot_once(monkeypatch):
    bursts = debounce.Bursts(1000)
    bursts.paths, bursts.slots = Calls(), Calls()
    monkeypatch.setattr(debounce.Bursts, "_ended", lambda self, key, timers: iter(()))
    frames = [pd.DataFrame({"micros": [i * 10 + k for i in range(500)], "path": ["a", "b"] * 250, "invalidates": "x"}) for k in range(4)]
    assert list(bursts.handleInputRows(("r",), iter(frames), None)) == []
    assert bursts.paths.writes == 2 and bursts.slots.rows == {(0,): (0, 4993)}
