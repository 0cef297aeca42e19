import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions.globs import any_glob, glob_regex, owner_glob
from graphloom.sources import extract, repo


@pytest.mark.parametrize(("glob", "path", "fits"), [
    ("src/**", "src/a/b.ts", True), ("**/x.ts", "x.ts", True), ("**/x.ts", "a/b/x.ts", True), ("*.ts", "a/b.ts", True), ("{a,b}/*.js", "b/c.js", True), ("{a,b}/*.js", "c/c.js", False), ("a?c", "abc", True), ("a.c", "abc", False), ("[!a]b", "ab", False),
])
def test_glob(glob, path, fits):
    assert bool(re.search(glob_regex(glob), path)) is fits


def test_glob_variants():
    assert not re.search(glob_regex("packages/*", star_crosses=False), "packages/a/b")
    assert re.search(owner_glob("/src/lib"), "src/library/x.ts")
    assert not re.search(any_glob([]), "anything")


def test_roles_and_names(spark):
    rows = [("src/a.test.ts", "test"), ("a/dist/x.js", "buildOutput"), ("x/generated/a.ts", "generated"), ("examples/a.ts", "example"), ("vite.config.ts", "config"), ("a.stories.tsx", "story"), ("src/a.ts", "source"), (None, "source")]
    got = spark.createDataFrame(rows, "p string, r string").select("r", C.file_role(F.col("p")).alias("g"), C.source_kind(F.col("p")).alias("k")).collect()
    assert [r["g"] for r in got] == [r for _, r in rows]
    names = [("@a/b/c", "@a/b"), ("x/y", "x"), ("./z", None), ("/z", None), (None, None), ("@a", None)]
    got = spark.createDataFrame(names, "s string, d string").select("d", C.dependency_name(F.col("s")).alias("g")).collect()
    assert [r["g"] for r in got] == [d for _, d in names]


def test_extract(spark):
    text = """// import x from 'no'
import a, {b as c, type D} from './a';
import * as ns from 'pkg/sub';
import './side.css';
export * from './star';
export {e as f} from './e';
export default function g() { return ns.one + ns.two }
export const h = 1; /* require('no2') */
const r = require('r'); import('./dyn'); new URL('./w.js', import.meta.url);
"""
    rows = {(f[0], f[1], f[2]) for f in extract.facts("a.ts", text)}
    assert {("import", "./a", "default"), ("import", "./a", "b"), ("import", "./a", "D"), ("import", "pkg/sub", "one"), ("import", "pkg/sub", "two"), ("side-effect", "./side.css", None), ("reexport", "./star", "*"), ("reexport", "./e", "e"), ("export", None, "default"), ("export", None, "h"), ("Require", "r", None), ("DynamicImport", "./dyn", None), ("UrlConstructor", "./w.js", None)} == rows
    df = spark.createDataFrame([("c.vue", "<template><MyCard/></template>\n<script>import X from './x'</script>"), (None, None)], "rel_path string, text string")
    got = {(r["kind"], r["name"]) for r in extract.extracted(df).collect()}
    assert ("component", "MyCard") in got and ("import", "default") in got


def test_readers(spark):
    assert repo.pnpm_packages("packages:\n  - 'a/*'\n  - b\ncatalog:\n  - c") == ["a/*", "b"]
    assert repo.codeowners("# x\n*.ts @a @b\n/docs @c # d\nalone\n") == [("*.ts", "@a"), ("/docs", "@c")]
    assert repo.without_comments('{"a": "//x", /* c */ "b": [1,], // d\n}') == '{"a": "//x",  "b": [1] \n}'
    lines = spark.createDataFrame([("A\ta",), ("R100\tb\tc",), ("D\td",), ("bad",)], "value string")
    assert {tuple(r) for r in repo.changes(lines).collect()} == {("added", "a", None), ("renamed", "c", "b"), ("deleted", "d", None)}
