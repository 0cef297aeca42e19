"""Aliases of tools' configurations, alone and in a scan."""

import json

from graphloom.operators import adapters
from graphloom.plans.scan import Scan


def test_tool_aliases(spark):
    files = {
        "package.json": {"jest": {"moduleNameMapper": {"^@api/(.*)$": "<rootDir>/src/api/$1", "^~$": "<rootDir>", "\\.(css|less)$": "<rootDir>/style.js", "^@x/(.+)$": ["<rootDir>/x/$1"]}}},
        "w/.babelrc": {"plugins": [["module-resolver", {"alias": {"@b": "./lib", "react": "preact/compat"}}]]},
        "w/.swcrc": {"jsc": {"paths": {"@s/*": ["./src/*", "../shared/*"]}}}, "v/.babelrc": "{broken",
    }
    rows = spark.createDataFrame([(p, t if isinstance(t, str) else json.dumps(t)) for p, t in files.items()], "rel_path string, text string")
    got = {tuple(r) for r in adapters.tool_aliases(adapters.config_inputs(rows)).select("prefix", "target", "scope", "origin").collect()}
    assert got == {
        ("@api", "src/api", "", "TsconfigPaths"), ("~", "", "", "TsconfigPaths"), ("\\.(css|less)", "style.js", "", "TsconfigPaths"), ("@b", "w/lib", "w", "Babel"), ("react", "w/preact/compat", "w", "Babel"),
        ("@s", "w/src", "w", "TsconfigPaths"), ("@s", "shared", "w", "TsconfigPaths"),
    }


def test_scan_follows_tool_aliases(spark):
    files = {
        "package.json": {"name": "app", "workspaces": ["w"], "main": "src/main.ts", "scripts": {"dev": "pnpm exec tsx -r @s/hook/on scripts/seed.ts && npm run other -- scripts/idle.ts"}, "dependencies": {"react": "1", "react-dom": "1", "left-pad": "1", "@s/hook": "1"}, "devDependencies": {"eslint-plugin-x": "1"}},
        "w/package.json": {"name": "w", "main": "m.ts"}, "w/.babelrc": {"plugins": [["module-resolver", {"alias": {"@b": "./lib"}}]]},
        "src/main.ts": "import '@b/out';", "w/m.ts": "import '@b/in';", "w/lib/in.ts": "", "w/lib/out.ts": "", "scripts/seed.ts": "", "scripts/idle.ts": "",
    }
    rows = spark.createDataFrame([(p, t if isinstance(t, str) else json.dumps(t)) for p, t in files.items()], "rel_path string, text string")
    s = Scan(rows)
    assert {(r["src"], r["dst"]) for r in s.file_edges.collect()} == {("w/m.ts", "w/lib/in.ts")}
    assert {r["subject"] for r in s.unused_files().collect()} == {"w/lib/out.ts", "scripts/idle.ts"}
    assert {r["subject"] for r in s.dependencies()[0].collect()} == {"left-pad"}
