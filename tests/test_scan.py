"""Scans of small repositories given as texts: their findings, graph and resolutions."""

import json

import pytest

from graphloom.operators import entrypoints, frameworks, report, resolve, rules
from graphloom.plans.scan import Scan
from graphloom.sources import config, repo


def scan(spark, files, **options):
    rows = [(path, text if isinstance(text, str) else json.dumps(text)) for path, text in {"package.json": {"name": "app"}, **files}.items()]
    return Scan(spark.createDataFrame(rows, "rel_path string, text string"), **options)


def found(s, *codes):
    return {(r["code"], r["subject"]) for r in s.findings.collect() if not codes or r["code"] in codes}


def test_unused_file(spark):
    s = scan(spark, {"src/index.ts": "import { used } from './used';\nused();", "src/used.ts": "export const used = () => 1;", "src/unused.ts": "export const unused = 1;"})
    rows = s.findings.collect()
    assert [(r["code"], r["subject"], r["confidence"], r["remedy"]) for r in rows] == [("unused-file", "src/unused.ts", "high", "delete-file")]
    assert s.exit_code() == 1 and s.summary().first()["files"] == 3
    proof, related = s.explain("src/used.ts")
    assert [r["path"] for r in proof.collect()] == [["src/index.ts", "src/used.ts"]] and related.count() == 0
    assert s.explain(rows[0]["id"])[0].count() == 0 and s.explain("src/unused.ts")[1].count() == 1
    kinds = {(r["node"], r["kind"]) for r in s.nodes.collect()}
    assert {("workspace:", "workspace"), ("package:app", "package"), ("src/index.ts", "file"), ("entry:src/index.ts", "entrypoint")} <= kinds
    lines = [r["value"] for r in s.dot().collect()]
    assert lines[0] == "digraph repository {" and lines[-1] == "}" and '  "src/unused.ts" [label="src/unused.ts", color=red];' in lines and '  "src/index.ts" -> "src/used.ts" [label="StaticImportValue"];' in lines


def test_stars_and_chains_of_reexports(spark):
    s = scan(spark, {"src/main.ts": "import { used } from './index';\nused;", "src/index.ts": "export * from './leaf';", "src/leaf.ts": "export const used = 1;\nexport const unused = 2;"}, include=("src/main.ts",))
    assert found(s, "unused-export") == set()  # the index is an entry point by its name, so all it passes on is wanted
    s = scan(spark, {"src/main.ts": "import { used } from './inner';\nused;", "src/inner.ts": "export * from './leaf';", "src/leaf.ts": "export const used = 1;\nexport const unused = 2;"})
    assert found(s) == {("unused-export", "src/leaf.ts#unused")}
    s = scan(spark, {"src/main.ts": "import { a } from './b';\na;", "src/b.ts": "export * from './c';", "src/c.ts": "export { deep as a } from './d';", "src/d.ts": "export const deep = 1;\nexport const unusedDeep = 2;"})
    assert found(s) == {("unused-export", "src/d.ts#unusedDeep")}


def test_types_and_uses_in_the_own_file(spark):
    s = scan(spark, {"src/main.ts": "import type { Foo } from './types';\nlet x: Foo;", "src/types.ts": "export type Foo = 1;\nexport type Bar = 2;\nexport const runtimeOnly = 3;\nexport const own = 4;\nconsole.log(own);"})
    assert found(s) == {("unused-type", "src/types.ts#Bar"), ("unused-export", "src/types.ts#runtimeOnly")}
    s.exports_used_in_file = False
    assert ("unused-export", "src/types.ts#own") in {(r["code"], r["subject"]) for r in s.unused_exports().collect()}


def test_manifest_fields_are_entry_points(spark):
    manifest = {"name": "app", "main": "./dist/cjs/main.js", "bin": {"x": "bin/x.ts"}, "browser": {"./a.js": "./shim.ts", "b": False}, "exports": {".": {"import": "./lib/e.mjs", "types": "./t.d.ts"}, "./deep": ["./deep.ts"]}, "scripts": {"dev": "node tools/dev.ts && echo", "build": "tsx tools/build.ts"}}
    names = ["src/main.ts", "bin/x.ts", "shim.ts", "src/e.ts", "t.d.ts", "deep.ts", "tools/dev.ts", "tools/build.ts", "index.js", "src/other.ts", "src/fixtures/index.ts", "a/index.ts"]
    s = scan(spark, {"package.json": manifest, **dict.fromkeys(names, "")}, include=("src/fixtures/*",))
    got = {(r["path"], r["kind"], r["profile"]) for r in s.entries.collect()}
    assert got == {*((p, "package-main", "production") for p in ("src/main.ts", "bin/x.ts", "shim.ts", "src/e.ts", "t.d.ts", "deep.ts")), ("tools/dev.ts", "package-script", "development"), ("tools/build.ts", "package-script", "production"), ("index.js", "convention", "production"), ("src/fixtures/index.ts", "explicit-config", "both")}
    assert found(s, "unused-file") == {("unused-file", "src/other.ts"), ("unused-file", "a/index.ts")}
    nodes, edges = entrypoints.entry_graph(s.entries, s.files)
    assert nodes.count() == 10 and ("package:app", "entry:index.js", "PackageToEntrypoint") in {tuple(r) for r in edges.collect()}


def test_cascade(spark):
    files = {
        "package.json": {"name": "root", "workspaces": ["packages/*"]}, "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./packages/a/src/*"], "@both/*": ["x/*"], /* c */ "exact": ["packages/b/index.ts"],}}}',
        "packages/a/package.json": {"name": "@w/a", "imports": {"#s/*": "./src/*.ts", "#none": "./gone.ts"}, "browser": {"node-only": "./src/shim.ts"}},
        "packages/a/tsconfig.json": {"compilerOptions": {"paths": {"@both/*": ["./src/*"]}}},
        "packages/b/package.json": {"name": "@w/b", "exports": {".": "./index.ts", "./u/*": "./util/*.ts"}}, "packages/c/package.json": {"name": "plain", "main": "lib/start.ts"},
        "packages/a/src/index.ts": "import a from '@/one'; import b from '@w/b'; import c from '@w/b/u/two'; import d from '@w/b/hidden'; import e from '#s/one'; import f from 'node-only'; import g from 'plain'; import h from 'plain/lib/more'; import i from '@both/one'; import j from 'exact'; import k from './sub'; import l from './gone'; import m from '#none'; import n from 'left-pad/x'; import o from '../../b/util/two';".replace("; ", ";\n"),
        "x/y.ts": "import a from '@both/z';", "x/z.ts": "", "packages/a/src/one.ts": "", "packages/a/src/shim.ts": "", "packages/a/src/sub/index.tsx": "", "packages/b/index.ts": "", "packages/b/util/two.ts": "", "packages/b/hidden.ts": "", "packages/c/lib/start.ts": "", "packages/c/lib/more.ts": "",
    }
    s = scan(spark, files)
    got = {(r["src"], r["specifier"]): (r["dst_file"] or r["dst_dep"], r["origin"], r["outcome"], r["reason"]) for r in s.resolutions.collect()}
    a, file = "packages/a/src/index.ts", "ResolvedToFile"
    assert got == {
        (a, "@/one"): ("packages/a/src/one.ts", "TsconfigPaths", file, None), (a, "@w/b"): ("packages/b/index.ts", "Manifest", file, None), (a, "@w/b/u/two"): ("packages/b/util/two.ts", "Manifest", file, None),
        (a, "@w/b/hidden"): (None, None, "Unresolved", "workspace-exports-miss"), (a, "#s/one"): ("packages/a/src/one.ts", "SubpathImports", file, None), (a, "node-only"): ("packages/a/src/shim.ts", "BrowserField", file, None),
        (a, "plain"): ("packages/c/lib/start.ts", "Manifest", file, None), (a, "plain/lib/more"): ("packages/c/lib/more.ts", "Manifest", file, None), (a, "@both/one"): ("packages/a/src/one.ts", "TsconfigPaths", file, None),
        (a, "exact"): ("packages/b/index.ts", "TsconfigPaths", file, None), (a, "./sub"): ("packages/a/src/sub/index.tsx", None, file, None), (a, "./gone"): (None, None, "Unresolved", "missing-file"), (a, "#none"): (None, None, "Unresolved", "exports-condition-miss"),
        (a, "left-pad/x"): ("left-pad", None, "ResolvedToDependency", None), (a, "../../b/util/two"): ("packages/b/util/two.ts", None, file, None), ("x/y.ts", "@both/z"): ("x/z.ts", "TsconfigPaths", file, None),
    }
    off = resolve.cascade(s.specifiers.join(s.files.selectExpr("rel_path as src", "root"), "src"), s.files, s.manifests, s.aliases, externals=["left-pad"], ignored=["./go*"])
    assert {r["specifier"] for r in off.where("outcome = 'Externalized' and reason = 'externalized'").collect()} == {"left-pad/x", "./gone"}


def test_dependencies(spark):
    manifest = {"name": "app", "workspaces": ["b"], "dependencies": {"used": "1", "idle": "1", "styled": "1", "@s/base": "1", "app2": "1"}, "devDependencies": {"vite": "1", "@types/node": "1", "idle-dev": "1"}, "peerDependencies": {"react": "1"}, "scripts": {"dev": "vite build"}}
    s = scan(spark, {"package.json": manifest, "b/package.json": {"name": "app2"}, "tsconfig.json": '{"extends": ["@s/base/tsconfig.json", "./own.json"]}', "src/main.ts": "import 'used/deep';\nimport fs from 'node:fs';\nimport path from 'path';\nimport x from 'missing';", "src/a.scss": "@use \"styled/x\";\n@import './local';\n@import 'https://x/y';"})
    assert found(s, "unused-dependency", "unlisted-dependency") == {("unused-dependency", "idle"), ("unused-dependency", "idle-dev"), ("unused-dependency", "react"), ("unlisted-dependency", "missing")}


def test_cycles_rules_and_owners(spark):
    files = {"src/index.ts": "import './a';\nimport { s } from './internal/secret';\ns;", "src/a.ts": "import './b';", "src/b.ts": "import './a';\nimport type { S } from './internal/secret';\nlet x: S;", "src/internal/secret.ts": "import type { X } from '../index';\nexport const s = 1;\nexport type S = 1;", "CODEOWNERS": "# all\nsrc/ @team-a @lead\nsrc/b.ts @team-b\n"}
    s = scan(spark, files, forbidden=(rules.Forbidden("no-internal", rules.End(path=("src/index.ts",)), rules.End(path=("src/internal/**",))),))
    got = found(s)
    assert {x for x in got if x[0] == "cycle"} == {("cycle", "src/a.ts -> src/b.ts -> src/a.ts")}
    assert {x for x in got if x[0] == "boundary-violation"} == {("boundary-violation", "src/index.ts -> src/internal/secret.ts")}
    assert {x[1] for x in got if x[0] == "ownership-cross-owner"} == {"src/a.ts -> src/b.ts", "src/b.ts -> src/a.ts", "src/b.ts -> src/internal/secret.ts"}
    assert config.owner_rules(s.rows) == [("src/", ["@team-a", "@lead"]), ("src/b.ts", ["@team-b"])]
    remedies = {r["code"]: r["remedy"] for r in s.findings.collect()}
    assert remedies["boundary-violation"] == "update-boundary-rule" and remedies["cycle"] == "break-cycle"


def test_globs_and_contexts(spark):
    files = {"src/main.ts": "import.meta.glob(['./modules/*.ts', '!./modules/excluded.ts']);\nrequire.context('./flat', false, /\\.ts$/);\nrequire.context('./deep');", "src/modules/a.ts": "", "src/modules/excluded.ts": "", "src/modules/sub/b.ts": "", "src/flat/a.ts": "", "src/flat/a.js": "", "src/flat/sub/a.ts": "", "src/deep/x/y.ts": ""}
    s = scan(spark, files)
    assert found(s, "unused-file") == {("unused-file", p) for p in ("src/modules/excluded.ts", "src/modules/sub/b.ts", "src/flat/a.js", "src/flat/sub/a.ts")}


def test_members(spark):
    files = {"src/main.ts": "import { Color, Service } from './m';\nconsole.log(Color.Red, Color.Blue);\nconst s = new Service();\ns.usedMethod();", "src/m.ts": "export enum Color {\n  Red,\n  Blue,\n  Yellow,\n}\nexport class Service {\n  usedMethod() {}\n  unusedMethod() {}\n  set value(x) {}\n  /** @public */\n  api() {}\n}\n"}
    got = {x[1] for x in found(scan(spark, files), "unused-member")}
    assert {"src/m.ts#Color.Yellow", "src/m.ts#Service.unusedMethod"} <= got and not got & {"src/m.ts#Service.api", "src/m.ts#Color.Red"}


def test_workspaces_and_configurations(spark, tmp_path):
    rows = spark.createDataFrame([("package.json", '{"name": "r"}'), ("p/a/package.json", '{"name": "a"}'), ("p/b/package.json", "{}"), ("p/no/package.json", '{"name": "n"}'), ("x/package.json", '{"name": "x"}'), ("tsconfig.json", "{bad"), ("a.config.json", "// c\n{}")], "rel_path string, text string")
    got = {tuple(r) for r in config.discovered(repo.manifests(rows), ["./p/*", "!p/no"]).collect()}
    assert got == {("", "r"), ("p/a", "a"), ("p/b", "p/b")}
    assert {tuple(r) for r in config.config_status(rows).where("rel_path not like '%package.json'").collect()} == {("tsconfig.json", "invalid"), ("a.config.json", "ok")}
    (tmp_path / "r" / "s" / "t").mkdir(parents=True)
    (tmp_path / "r" / "package.json").write_text("{}")
    assert config.project_root(str(tmp_path / "r" / "s" / "t"), ["package.json"]) == str(tmp_path / "r")


def test_sinks_and_empty(spark, tmp_path):
    s = scan(spark, {"src/index.ts": "", "src/unused.ts": ""})
    for form in ("json", "text", "dot"):
        s.write(f"file://{tmp_path}/{form}", form)
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/text").collect()] == ["warn unused-file high src/unused.ts"]
    assert spark.read.json(f"file://{tmp_path}/json").count() == 1
    with pytest.raises(ValueError):
        s.write("x", "xml")
    empty = Scan(spark.createDataFrame([], "rel_path string, text string"))
    assert empty.findings.count() == 0 and empty.exit_code() == 0 and empty.dot().count() == 2


def test_frameworks(spark):
    files = {"package.json": {"name": "app", "workspaces": {"packages": ["w"]}, "devDependencies": {"vitest": "1"}}, "w/package.json": {"name": "w", "dependencies": {"next": "1"}}, "src/a.test.ts": "import './util';", "src/util.ts": "", "vitest.config.ts": "", "w/app/x/page.tsx": "", "w/lib/y.ts": "", "w/middleware.ts": ""}
    s = scan(spark, files)
    assert {(r["root"], r["framework"], r["confidence"]) for r in s.frameworks.collect()} == {("", "vitest", "exact"), ("w", "next", "heuristic")}
    assert {(r["path"], r["kind"], r["profile"]) for r in s.entries.collect()} == {("src/a.test.ts", "framework-pack", "development"), ("vitest.config.ts", "framework-pack", "development"), ("w/app/x/page.tsx", "framework-pack", "production"), ("w/middleware.ts", "framework-pack", "production")}
    assert found(s, "unused-file") == {("unused-file", "w/lib/y.ts")}
    assert [(r["subject"], r["frameworks"]) for r in s.in_context().where("code = 'unused-file'").collect()] == [("w/lib/y.ts", ["next"])]
    assert [r["note"] for r in frameworks.trust_notes(s.frameworks).collect()] == ["next was found by a dependency only"]
    assert [tuple(r) for r in s.inventories()[1].collect()] == [("app", "", 3), ("w", "w", 3)]
    assert s.debug_resolve("./util", "src/a.test.ts") == "./util from src/a.test.ts: ResolvedToFile src/util.ts" and "no specifier" in s.debug_resolve("x", "y")
    off = scan(spark, files, toggles={"vitest": "off", "astro": "on"})
    assert {(r["root"], r["framework"]) for r in off.frameworks.collect()} == {("w", "next"), ("", "astro"), ("w", "astro")}


def test_reports(spark):
    chains = spark.createDataFrame([("a", ["a", "b", "c", "a"]), ("x", ["x"])], "component string, chain array<string>")
    assert [tuple(r) for r in report.break_edges(chains).collect()] == [("a", 0, "a", "b"), ("a", 1, "b", "c"), ("a", 2, "c", "a")]
    back, lost = report.recovered(spark.createDataFrame([("a",), ("z",)], "path string"), spark.createDataFrame([("a", 7), ("b", 8)], "path string, file_id long"))
    assert [tuple(r) for r in back.collect()] == [("a", 7)] and [r["path"] for r in lost.collect()] == ["z"]
