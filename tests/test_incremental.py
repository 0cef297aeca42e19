"""Maintained reachability against a rebuild over random changes; the fact store; configurations of tools."""

import json
import random

from pyspark.sql import functions as F

from graphloom.operators import adapters, incremental
from graphloom.operators.tables import Rounds
from graphloom.sources.extract import extracted


def reached_by_force(edges, seeds):
    seen, front = set(seeds), list(seeds)
    while front:
        at = front.pop()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                front.append(b)
    return seen


def test_maintained_reachability_equals_a_rebuild(spark):
    rng = random.Random(4)
    for k in range(4):
        old = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)}
        new = {e for e in old if rng.random() > 0.1 + 0.3 * (k == 3)} | {(rng.randrange(70), rng.randrange(70)) for _ in range(8)}
        seeds, later = {1, 2, 3, 4}, {2, 3, 4, 65} if k else {1, 2, 3, 4}
        edges = lambda e: spark.createDataFrame(sorted(e) or [(None, None)], "src long, dst long")
        nodes = lambda n: spark.createDataFrame([(x,) for x in sorted(n)], "node long")
        got = incremental.reached_after(edges(old), edges(new), nodes(seeds), nodes(later), nodes(reached_by_force(old, seeds)))
        rows = [r["node"] for r in got.collect()]
        assert set(rows) == reached_by_force(new, later) and len(rows) == len(set(rows))


def test_facts_are_read_once_for_each_text(spark):
    store = f"{Rounds(spark).root}/store"
    texts = {"a.ts": "import './b';", "b.ts": "export const x = 1;", "c.ts": None}
    frame = lambda t: spark.createDataFrame(list(t.items()), "rel_path string, text string")
    plain = lambda d: sorted(map(str, d.select("rel_path", "kind", "specifier", "name").collect()))
    assert incremental.stored_facts(frame(texts).limit(0), store, extracted)[0].count() == 0
    for change, reads in (({}, 3), ({}, 0), ({"a.ts": "import './c';", "d.ts": "import './a';"}, 2), ({"a.ts": "import './b';"}, 0)):
        texts |= change
        facts, n = incremental.stored_facts(frame(texts), store, extracted)
        assert n == reads and plain(facts) == plain(extracted(frame(texts)))


def test_configurations_of_tools(spark):
    files = {
        "package.json": {"name": "app", "jest": {"moduleNameMapper": {"^@/(.*)$": "<rootDir>/src/$1"}, "setupFilesAfterEnv": ["./test/setup.ts"], "testMatch": ["**/*.check.ts"], "testEnvironment": "jsdom"}, "eslintConfig": {"extends": ["airbnb"], "overrides": [{"parser": "@babel/eslint-parser"}]}, "prettier": "@org/prettier", "lint-staged": {"*.ts": ["eslint --fix", "tsc"]}, "husky": {"hooks": {"pre-commit": "lint-staged"}}, "prisma": {"seed": "tsx prisma/seed.ts"}, "ava": {"files": ["t/*.ts"], "require": ["./t/setup.ts"]}, "tsup": {"entry": ["src/main.ts"]}, "targets": {"web": {"source": "src/web.ts"}}, "vue": {"pages": {"index": {"entry": "src/vue.ts"}, "more": "src/more.ts"}}, "build": {"extends": "electron-base"}},
        ".babelrc": '{"presets": [["env", {"targets": "x"}]], /* c */ "plugins": ["macros", ["module-resolver", {"alias": {"~": "./src"}}],]}',
        ".swcrc": {"jsc": {"paths": {"@/*": ["./src/*"]}, "experimental": {"plugins": [["@swc/plugin", {}]]}}}, "w/angular.json": {"projects": {"p": {"architect": {"build": {"builder": "@angular/build:app", "options": {"main": "src/main.ts", "polyfills": ["zone.js"]}}}}}},
        ".mocharc.json": {"spec": "spec/*.ts", "require": ["ts-node/register"], "file": ["./spec/first.ts"]}, "nx.json": {"plugins": ["@nx/js", {"plugin": "@nx/vite"}]}, "w/project.json": {"targets": {"serve": {"executor": "@nx/node:run", "options": {"main": "src/serve.ts"}}}},
        "turbo.json": {"tasks": {"build": {"inputs": ["src/**"]}}, "globalDependencies": ["env"]}, "lerna.json": {"packages": ["packages/*"]}, ".changeset/config.json": {"ignore": ["docs"], "changelog": "@changesets/changelog"}, "other/config.json": {"ignore": ["no"]}, "typedoc.json": {"entryPoints": ["src/api.ts"], "exclude": ["**/x"], "plugin": ["td"]},
        "cypress.json": {"supportFile": "cy/support.ts", "pluginsFile": "cy/plugins.ts", "integrationFolder": "cy", "testFiles": "**/*.cy.ts"}, "drizzle.config.json": {"schema": "db/schema.ts", "out": "db/out"}, ".postcssrc.json": {"plugins": {"autoprefixer": {"grid": True}, "cssnano": None}}, ".commitlintrc.json": {"extends": ["conventional"]}, ".parcelrc": {"extends": "@parcel/config", "transformers": {"*.svg": ["svg-t"]}}, "broken.json": "{", "jest.config.json": "{bad",
    }
    rows = spark.createDataFrame([(p, t if isinstance(t, str) else json.dumps(t)) for p, t in files.items()], "rel_path string, text string")
    inputs = adapters.config_inputs(rows).cache()
    got = {(r["root"], r["tool"], r["kind"], r["value"]) for r in inputs.collect()}
    want = {
        ("", "jest", "alias", "<rootDir>/src/$1"), ("", "jest", "setup", "./test/setup.ts"), ("", "jest", "test", "**/*.check.ts"), ("", "jest", "package", "jsdom"), ("", "eslint", "package", "airbnb"), ("", "eslint", "package", "@babel/eslint-parser"),
        ("", "prettier", "package", "@org/prettier"), ("", "lint-staged", "command", "eslint --fix"), ("", "husky", "command", "lint-staged"), ("", "prisma", "command", "tsx prisma/seed.ts"), ("", "ava", "test", "t/*.ts"), ("", "tsup", "entry", "src/main.ts"),
        ("", "parcel-targets", "entry", "src/web.ts"), ("", "vue", "entry", "src/vue.ts"), ("", "vue", "entry", "src/more.ts"), ("", "electron", "package", "electron-base"), ("", "babel", "package", "env"), ("", "babel", "package", "macros"), ("", "babel", "alias", "./src"),
        ("", "swc", "alias", "./src/*"), ("", "swc", "package", "@swc/plugin"), ("w", "angular", "entry", "src/main.ts"), ("w", "angular", "setup", "zone.js"), ("w", "angular", "package", "@angular/build:app"), ("", "mocha", "test", "spec/*.ts"), ("", "mocha", "setup", "./spec/first.ts"),
        ("", "nx", "package", "@nx/js"), ("", "nx", "package", "@nx/vite"), ("w", "nx", "entry", "src/serve.ts"), ("w", "nx", "package", "@nx/node:run"), ("", "turborepo", "root", "src/**"), ("", "lerna", "root", "packages/*"), ("", "changesets", "ignore", "docs"), ("", "typedoc", "entry", "src/api.ts"),
        ("", "cypress", "setup", "cy/support.ts"), ("", "cypress", "test", "**/*.cy.ts"), ("", "drizzle", "ignore", "db/out"), ("", "postcss", "package", "autoprefixer"), ("", "commitlint", "package", "conventional"), ("", "parcel", "package", "svg-t"),
    }
    assert want <= got and not {g for g in got if g[3] == "no"} and len({g[1] for g in got}) >= 20
    deps = {(r["root"], r["dep"]) for r in adapters.packages(inputs).collect()}
    assert {("", "jest-environment-jsdom"), ("", "eslint-config-airbnb"), ("", "babel-preset-env"), ("", "babel-plugin-macros"), ("", "ts-node"), ("", "tsc"), ("w", "@angular/build"), ("w", "@nx/node"), ("", "commitlint-config-conventional")} <= deps
    assert adapters.config_inputs(rows.limit(0)).count() == 0
    assert inputs.where(F.col("rel_path") == "jest.config.json").count() == 0


def test_facts_of_two_runs_in_one_query(spark, tmp_path):
    store, broadcast = f"file://{tmp_path}/store", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = [spark.createDataFrame([("a.ts", "import './b';"), ("b.ts", last)], "rel_path string, text string") for last in ("export const b = 1;", "import './a';\nimport './c';")]
        facts = [incremental.stored_facts(rows, store, extracted)[0].agg(F.count("specifier").alias("n")) for rows in runs]
        assert [r["n"] for r in facts[0].unionByName(facts[1]).collect()] == [1, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
