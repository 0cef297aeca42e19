"""One scan of a folder on disk, from the walk to the findings: everything that only shows when files come through the walk."""

import json

import pytest

from graphloom.operators import rules
from graphloom.plans.scan import Scan
from graphloom.sources.repo import walk

FILES = {
    "package.json": {"name": "app", "workspaces": ["packages/*"], "dependencies": {"live": "1", "dead-only": "1", "sass-lib": "1"}, "devDependencies": {"tool": "1"}, "scripts": {"dev": "node ./scripts/gen.ts"}},
    "packages/idle/package.json": {"name": "idle"}, "packages/idle/src/lonely.ts": "export const x = 1;",
    "fixture/package.json": {"name": "made-up", "main": "src/a.ts"},
    "CODEOWNERS": "/src/ @core @lead\n/src/b.ts @b\n/src/c.ts @c\n/scripts/ @tools\n",
    ".gitignore": "generated-out/\n*.skip.ts\n", "generated-out/x.ts": "", "src/left.skip.ts": "",
    "src/index.ts": "import { a } from './a.js';\nimport 'live';\nimport './shared.ts';\nimport './pass.js';\na;",
    "src/a.ts": "import type { B } from './b.js';\nexport const a = 1;\nexport type B2 = B;\nexport class K {\n  get v() { return 1; }\n  set v(x) {}\n  used() {}\n}\nnew K().used();",
    "src/b.ts": "import { a } from './a';\nimport './shared';\nexport type B = typeof a;",
    "src/c.ts": "import './shared';", "src/shared.ts": "",
    "src/leaf.ts": "export const one = 1;", "src/pass.ts": "export { one } from './leaf';\nexport { one as two } from './leaf';\nimport './c';",
    "src/dead.ts": "import 'dead-only';", "src/style.css": "@import 'sass-lib/base';",
    "scripts/gen.ts": "import { a } from '../src/a.mjs';\nimport '../src/internal/secret';\nimport 'tool';", "src/internal/secret.ts": "", "vendor/free.ts": "",
}


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text if isinstance(text, str) else json.dumps(text))
    return f"file://{root}"


def test_a_folder_from_walk_to_findings(spark, repository):
    forbidden = (
        rules.Forbidden("scripts-keep-out", rules.End(profiles=("development",), entry_kinds=("package-script",)), rules.End(tag=("private",))),
        rules.Forbidden("tags", rules.End(tag=("entrypoint-kind:convention",), tag_not=("plain",)), rules.End(path=("src/a.ts",))),
    )
    s = Scan(walk(spark, repository), forbidden=forbidden, tags=(("src/internal/**", "private"), ("src/b.ts", "plain")))
    rows = s.findings.collect()
    got = {(r["code"], r["subject"]): r for r in rows}
    of = lambda code: {x for c, x in got if c == code}
    assert {r["rel_path"] for r in s.files.collect()} == {p for p in FILES if p.endswith(".ts") and "skip" not in p and "generated-out" not in p}
    # Built endings stand for sources, also the one that doesn't fit.
    assert of("unused-file") == {"src/dead.ts", "packages/idle/src/lonely.ts", "vendor/free.ts", "fixture/src/a.ts"} - {"fixture/src/a.ts"}
    assert s.pressure.where("unresolved > 0").count() == 1  # only '../src/a.mjs'
    assert of("unused-dependency") == {"dead-only"} and got["unused-dependency", "dead-only"]["confidence"] == "medium"
    assert of("unused-package") == {"idle"} and got["unused-package", "idle"]["confidence"] == "medium"
    assert of("cycle") == {"src/a.ts -> src/b.ts -> src/a.ts"}
    assert got["cycle", "src/a.ts -> src/b.ts -> src/a.ts"]["evidence"] == ["src/a.ts -> src/b.ts", "src/b.ts -> src/a.ts"]
    assert of("duplicate-export") == {"src/leaf.ts"} and got["duplicate-export", "src/leaf.ts"]["evidence"][0] == "one"
    assert not {x for x in of("unused-member") if x.endswith(".v")}
    assert of("ownership-unowned") == {"packages/idle/src/lonely.ts", "vendor/free.ts"}
    assert {"src/b.ts -> src/shared.ts", "src/c.ts -> src/shared.ts", "scripts/gen.ts -> src/internal/secret.ts"} <= of("ownership-cross-owner")
    assert of("ownership-hotspot") == {"src/shared.ts"} and got["ownership-hotspot", "src/shared.ts"]["severity"] == "info"
    assert {r["category"] for r in rows if r["code"].startswith("ownership")} == {"ownership-violation"}
    assert {(r["rule_name"], r["subject"]) for r in rows if r["code"] == "boundary-violation"} == {("scripts-keep-out", "scripts/gen.ts -> src/internal/secret.ts"), ("tags", "src/index.ts -> src/a.ts")}
    assert got["unused-package", "idle"]["workspace"] is None and got["unused-file", "packages/idle/src/lonely.ts"]["workspace"] == "idle"
    production = Scan(walk(spark, repository), forbidden=forbidden, profile="production", tags=s.tags)
    assert production.boundaries().select("rule_name").distinct().collect() == [("tags",)]
    assert {r["subject"] for r in production.dependencies()[0].collect()} == {"dead-only"}
