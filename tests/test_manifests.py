import json

import pytest

from graphloom.operators import manifests, tags

EXPORTS = {".": {"require": "./d.cjs", "import": {"types": "./t.d.ts", "default": "./i.mjs"}}, "./gone": None, "./in/*": None, "./*": "./src/*/*.js", "./x/*": [{"deno": "./dx/*.ts"}]}


@pytest.fixture(scope="module")
def maps(spark):
    rows = [
        ("a", "pa", json.dumps(EXPORTS), json.dumps({"#u": "./u.ts", "#s/*": {"node": "./n/*.ts"}, "#no/*": None}), json.dumps({"fs": "./fs.js", "net": False})),
        ("b", "pb", '"./main.js"', None, '"./b.js"'), ("c", None, "{no json", "[]", "3"), ("d", "pd", json.dumps([{"./k": None}, {"./k": "./k2.js"}]), "", None),
    ]
    return manifests.manifest_maps(spark.createDataFrame(rows, "workspace string, package string, exports string, imports string, browser string"))


def found(spark, maps, field, *requests):
    rows = spark.createDataFrame(list(requests), "workspace string, specifier string")
    return {(r["workspace"], r["specifier"]): (r["target"], r["defined"]) for r in manifests.looked_up(rows, maps, field).collect()}


def test_exports(spark, maps):
    asked = [("a", "."), ("a", "./gone"), ("a", "./in/y"), ("a", "./q"), ("a", "./x/y"), ("a", None), ("b", "."), ("b", "./z"), ("c", "."), ("d", "./k"), (None, ".")]
    got = found(spark, maps, "exports", *asked)
    assert got[("a", ".")] == ("t.d.ts", True)
    assert got[("a", "./gone")] == (None, True)  # barred
    assert got[("a", "./in/y")] == ("src/in/y/in/y.js", True)  # a wildcard without a target is passed over, and each star is filled
    assert got[("a", "./q")] == ("src/q/q.js", True)
    assert got[("a", "./x/y")] == ("src/x/y/x/y.js", True)  # the first wildcard in order, not the longest
    assert got[("b", ".")] == ("main.js", True)
    assert got[("d", "./k")] == ("k2.js", True)
    assert {got[k] for k in [("b", "./z"), ("c", "."), (None, "."), ("a", None)]} == {(None, False)}


def test_imports_and_browser(spark, maps):
    got = found(spark, maps, "imports", ("a", "#u"), ("a", "#s/k"), ("a", "#no/k"), ("a", "#t"), ("b", "#u"))
    assert got == {("a", "#u"): ("u.ts", True), ("a", "#s/k"): ("n/k.ts", True), ("a", "#no/k"): (None, True), ("a", "#t"): (None, False), ("b", "#u"): (None, False)}
    got = found(spark, maps, "browser", ("a", "fs"), ("a", "net"), ("b", "pb"))
    assert got == {("a", "fs"): ("fs.js", True), ("a", "net"): (None, False), ("b", "pb"): ("b.js", True)}


def test_wildcard_files(spark, maps):
    files = spark.createDataFrame([("a", "src/k/l.js"), ("a", "./dx/k.ts"), ("a", "lib/k.js"), ("b", "src/k.js")], "workspace string, path string")
    assert {tuple(r) for r in manifests.wildcard_files(maps, files).collect()} == {("a", "./dx/k.ts")}


def test_tags(spark):
    teams = spark.createDataFrame([("core", ["src/**"], None), ("ui", [], []), ("ops", ["x"], ["t"])], "team string, paths array<string>, tags array<string>")
    files = spark.createDataFrame([("@w/a", "p.q", f"Store/store/{i}.ts") for i in range(3)] + [(None, None, "hooks/a.ts")], "workspace string, package string, rel_path string")
    got = {(r["name"], r["glob"]) for r in tags.structure_tags(files, teams).collect()}
    assert got == {("ws--w-a", "@w/a"), ("pkg-p-q", "p.q"), ("team-core", "src/**"), ("team-ui", "<ui-paths>")}
    assert [tuple(r) for r in tags.role_tags(files).collect()] == [("role-store", "**/store/**", "file-pattern", 6)]
    out = {r["name"]: json.loads(r["override"]) for r in tags.tag_assignments(tags.structure_tags(files)).collect()}
    assert out == {"ws--w-a": {"workspaces": ["@w/a"], "tags": ["ws--w-a"]}, "pkg-p-q": {"files": ["p.q"], "tags": ["pkg-p-q"]}}


def test_fences(spark):
    files = spark.createDataFrame([("w", "p"), ("w", None), ("v", "q"), ("u", "r")], "workspace string, package string")
    entries = spark.createDataFrame([("w", "test"), ("w", "jest"), ("v", "test"), ("v", "main")], "workspace string, kind string")
    assert [tuple(r) for r in tags.fences(entries, files).collect()] == [("p", ["jest", "test"])]
