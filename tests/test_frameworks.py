"""Every pack by its dependency, by its files, and by both."""

import pytest

from graphloom.functions.globs import any_glob
from graphloom.operators import frameworks

# A file that tells of the pack, an entry point, a file beside it that is none, a generated file.
SHOWN = {
    "file-routing": ("src/routes/a.ts", "src/router.tsx", "src/router2.tsx", "src/routeTree.gen.ts"), "remix": (None, "app/entry.client.jsx", "app/other.tsx", "build/x.js"),
    "nx": ("nx.json", None, "libs/a.ts", ".nx/a.js"), "turborepo": ("turbo.json", None, "a.ts", None), "angular": ("angular.json", "src/main.ts", "src/app/b.ts", ".angular/x.js"),
    "rspack": ("rspack.config.mts", "src/index.jsx", "src/index2.ts", "dist/a.js"), "rsbuild": ("rsbuild.config.cjs", "src/index.tsx", "src/config.ts", "dist/a.js"), "rollup": ("rollup.config.js", "src/index.ts", "src/a.ts", "dist/a.js"),
    "gatsby": ("gatsby-config.ts", "gatsby-ssr.js", "gatsby-other.js", "public/a.js"), "playwright": ("playwright.config.ts", "e2e/x/a.spec.ts", "e2e/x/a.test.ts", None), "cypress": ("cypress.config.ts", "cypress/support/e2e.ts", "cypress/support/in/a.ts", None),
    "vitepress": (".vitepress/config.mts", ".vitepress/theme/x/a.ts", "docs/a.ts", ".vitepress/dist/a.js"), "docusaurus": ("docusaurus.config.js", "src/theme/x/y.tsx", "src/other/y.tsx", ".docusaurus/a.js"),
    "trigger-dev": ("trigger.config.ts", "trigger/x/y.ts", "src/trigger.ts", ".trigger/a.js"),
}


def test_packs(spark):
    packs = {p.name: p for p in frameworks.PACKS}
    assert len(packs) == len(frameworks.PACKS) == 23
    files, manifests, want, entries, generated = [], [], set(), set(), set()
    for name, (config, entry, other, made) in SHOWN.items():
        p = packs[name]
        for way in ("dep", "config", "both", "none"):
            root = f"{name}-{way}"
            deps = {p.dependencies[0]: "1"} if way in ("dep", "both") else {p.beside[0]: "1"} if p.beside and way == "config" else {}
            manifests.append((root, {} if p.dev_only else deps, deps if p.dev_only else None))
            files += [(f"{root}/{f}", root) for f in ((config if way in ("config", "both") else None), entry, other, made) if f]
            if way == "none" or (way == "config" and config is None):
                continue
            want.add((root, name, "exact" if way == "both" and config or p.sure and way != "config" else "heuristic"))
            entries |= {(f"{root}/{entry}", name)} if entry else set()
            entries |= {(f"{root}/{config}", name)} if config and way != "dep" and config not in ("nx.json", "turbo.json", "angular.json") else set()
            entries |= {(f"{root}/{made}", name)} if name == "file-routing" else set()  # its generated tree is an entry too
            generated |= {(f"{root}/{made}", name)} if made else set()
    found = frameworks.detections(spark.createDataFrame(files, "rel_path string, root string"), spark.createDataFrame(manifests, "root string, dependencies map<string,string>, devDependencies map<string,string>")).cache()
    mine = lambda df, *c: {tuple(r) for r in df.where(df.framework.isin(*SHOWN)).select(*c).collect() if r["framework"] == r[0].split("/")[0].rsplit("-", 1)[0]}
    sources = spark.createDataFrame(files, "rel_path string, root string")
    assert mine(found, "root", "framework", "confidence") == want
    assert mine(frameworks.framework_entries(found, sources), "path", "framework") == entries
    assert mine(frameworks.generated_files(found, sources), "path", "framework") == generated


def test_always_and_folders_alone(spark):
    files = spark.createDataFrame([("eslint.config.mjs", ""), ("w/sentry.edge.config.ts", "w"), ("w/sentry.edge.config.js", "w"), ("w/in/knexfile.js", "w"), ("src/routes/a.ts", "")], "rel_path string, root string")
    found = frameworks.detections(files, spark.createDataFrame([("", None, None), ("w", None, None)], "root string, dependencies map<string,string>, devDependencies map<string,string>"))
    assert found.count() == 0  # a folder of routes alone tells nothing
    assert {tuple(r) for r in frameworks.framework_entries(found, files).select("path", "framework").collect()} == {("eslint.config.mjs", "root-config"), ("w/sentry.edge.config.ts", "root-config")}


@pytest.mark.parametrize("path", ["e2e/a.spec.ts", "e2e/x/y/a.spec.ts"])
def test_spec_globs(spark, path):
    assert spark.createDataFrame([(path,)], "p string").where(f"p rlike r'{any_glob(['e2e/**/*.spec.*'], star_crosses=False)}'").count() == 1
