"""A few manifests that name many files: leaves hold their own scalar, and the work on what is named is dealt to all tasks."""

import json
import posixpath
import re

import pyarrow as pa

from graphloom.operators import adapters, entrypoints, frameworks
from graphloom.operators.tables import in_batches


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_leaves_of_odd_files(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1,"h":{"i":2}}}}}}}}'
    texts = ['{"a":[1,1.10,1e3,null,true,{"b":"x"}],/* c */"d":"//no",} rest', '{"a":1,"a":2}', '{"a":NaN}', "", None, '"s"', "[[],{},[7]]", deep, '{"":"e","[]":"k"}', '{"a":"\\ud800","\\ud801":3}']
    found = adapters.leaves(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "rel_path string, text string"))
    assert sorted(((r["rel_path"], *r["keys"]), r["value"]) for r in found.where("value is not null").collect()) == [
        (("0", "a", "[]"), "1"), (("0", "a", "[]"), "1.1"), (("0", "a", "[]"), "1000.0"), (("0", "a", "[]"), "true"), (("0", "a", "[]", "b"), "x"), (("0", "d"), "//no"),
        (("6", "[]", "[]"), "7"), (("7", *"abcdefg"), "1"), (("8", ""), "e"), (("8", "[]"), "k"), (("9", "?"), "3"), (("9", "a"), "?")]
    assert found.where("value is null").count() == 1


def test_leaves_of_a_large_manifest(spark):
    text = json.dumps({"bin": {f"f{i}": f"./dist/f{i}.js" for i in range(30_000)}, "jest": {"preset": "p"}})
    rows = spark.createDataFrame([("a/package.json", text)], "rel_path string, text string")
    found = adapters.leaves(rows)
    assert "variant_explode" not in plan(found) and plan(found).count("MapInArrow") == 1
    assert found.count() == 30_001
    assert [tuple(r) for r in adapters.config_inputs(rows).collect()] == [("a", "a/package.json", "jest", "package", "preset", "p")]


def test_named_files_are_dealt(spark):
    fields = ["root", "main", "module", "types", "typings", "browser", "bin", "exports"]
    bins = json.dumps({f"f{i}": f"./dist/esm/f{i}.js" for i in range(25_000)})
    named = entrypoints.manifest_files(spark.createDataFrame([("p", "x.js", None, None, None, None, bins, None)], ", ".join(f"{f} string" for f in fields)))
    assert named.count() == 25_001
    files = spark.createDataFrame([(f"p/src/f{i}.ts",) for i in range(0, 25_000, 1000)], "rel_path string")
    found = entrypoints.with_sources(named, files)
    assert "RepartitionByExpression" in plan(found)
    assert {(r["file"], r["path"]) for r in found.collect()} == {(f"./dist/esm/f{i}.js", f"p/src/f{i}.ts") for i in range(0, 25_000, 1000)}


def test_sources_of_odd_names(spark):
    names = ["dist/a.js", "./dist/esm/f.d.ts", "dist/..", "dist/", "dist/.", "./dist/.js", "lib/esm/g/h.js", "out/cjs/../x.js", "build/a.b.js", "src/a.ts", "./a.ts", "dist/../a.js", "", "dist//f.js", "dist/./f", "x"]
    paths = ["src/a.ts", "a.ts", "p/src/f.ts", "p/src/..ts", "src/.ts", "p/dist/f.js", "p/src/g/h.tsx", "p/x.mts", "x", "p/.ts", "p/..ts", "p/src/a.b.ts", "p/a.ts", "p/src/a.ts", "p/src/a.tsx", "p/x.js"]

    def path(root, name):
        return posixpath.normpath(f"{root}/{name}").strip("/") if f"{root}{name}" else ""

    def first(root, name):
        body = name.removeprefix("./")
        tried = [path(root, name)]
        if re.match("(dist|build|out|lib)/", body):
            stem = re.sub(r"(\.d)?\.[^./]*$", "", re.sub("^(dist|build|out|lib)/((esm|cjs|source|types)/)?", "", body))
            tried += [path(root, f"src/{stem}.{s}") for s in entrypoints.SOURCE_SUFFIXES] + [path(root, f"{stem}.{s}") for s in entrypoints.BESIDE_SUFFIXES]
        return next((p for p in tried if p in paths), None)

    rows = [(root, name) for root in ("", "p") for name in names]
    got = entrypoints.with_sources(spark.createDataFrame(rows, "root string, file string"), spark.createDataFrame([(p,) for p in paths], "rel_path string"))
    assert {tuple(r) for r in got.collect()} == {(*row, first(*row)) for row in rows if first(*row)}


def test_packs_meet_files_once(spark):
    files = spark.createDataFrame([(r, f"{r}/{f}") for r in "wo" for f in ("app/a.ts", "postcss.config.js")], "root string, rel_path string")
    found = frameworks.detections(files, spark.createDataFrame([("w", {"next": "1"}, None)], "root string, dependencies map<string,string>, devDependencies map<string,string>"))
    rows = frameworks.framework_entries(found.localCheckpoint(), files)
    assert plan(rows).count("Generate ") == 1
    assert {(r["path"], r["framework"]) for r in rows.collect()} == {("w/app/a.ts", "next"), ("w/postcss.config.js", "root-config"), ("o/postcss.config.js", "root-config")}


def test_batches():
    schema = pa.schema([("a", pa.int64()), ("b", pa.string())])
    assert [b.to_pylist() for b in in_batches(((i, str(i)) for i in range(5)), schema, 2)] == [[{"a": i, "b": str(i)} for i in k] for k in ([0, 1], [2, 3], [4])]
    assert list(in_batches([], schema)) == []
