"""Frameworks as rows: how each is detected in a workspace, and which files it makes entry points or generates.

A pack is data, so another framework is another row, and all packs are tested in one pass over the files of each workspace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.globs import any_glob


@dataclass(frozen=True)
class Pack:
    """``dev_only`` asks for a development dependency. Globs are of paths from the workspace's root.

    A pack with ``beside`` is not found by files alone: one of those dependencies must be there too. ``sure`` makes a dependency alone exact. A pack for ``always`` brings
    entry points to every workspace and is not detected.
    """

    name: str
    dependencies: tuple[str, ...]
    configs: tuple[str, ...]
    entries: tuple[str, ...]
    profile: str
    generated: tuple[str, ...] = ()
    dev_only: bool = False
    beside: tuple[str, ...] = ()
    sure: bool = False
    always: bool = False


# Endings of configuration files, and of sources of frameworks.
_CONFIG, _CODE = "{ts,js,mjs,cjs,mts}", "{tsx,ts,jsx,js}"


# Packs of frameworks.
PACKS = (
    Pack("next", ("next",), ("next.config.{js,mjs,ts}",), ("app/**", "pages/**", "next.config.{js,mjs,ts}", "instrumentation.{ts,js}", "instrumentation-client.{ts,js}", "src/instrumentation.{ts,js}", "middleware.{ts,js}", "src/middleware.{ts,js}"), "production"),
    Pack("vite", ("vite",), ("vite.config.{ts,js}",), ("vite.config.{ts,js,mts}",), "production", ("dist/**",), True),
    Pack("vitest", ("vitest",), ("vitest.config.ts",), ("vitest.config.{ts,js,mts}", "**/*.test.*", "**/*.spec.*", "**/__tests__/**"), "development", (), True),
    Pack("jest", ("jest",), ("jest.config.{js,ts}",), ("jest.config.{js,ts,cjs,mjs}", "**/*.test.*", "**/*.spec.*", "**/__tests__/**"), "development", (), True),
    Pack("storybook", ("storybook", "@storybook/react", "@storybook/vue3", "@storybook/angular"), (".storybook/**",), (".storybook/{main,preview}.{ts,tsx,js}", "**/*.stories.*", "**/*.story.*"), "development", ("storybook-static/**",), True),
    Pack("nuxt", ("nuxt",), ("nuxt.config.{ts,js,mjs,cjs,mts}",), ("app.vue", "nuxt.config.{ts,js,mjs,cjs,mts}", "composables/**", "plugins/**", "utils/**"), "production", (".nuxt/**", ".output/**")),
    Pack("astro", ("astro",), ("astro.config.{ts,js,mjs,cjs,mts}",), ("src/pages/**", "astro.config.{ts,js,mjs,cjs,mts}"), "production", ("dist/**", ".astro/**")),
    Pack("sveltekit", ("@sveltejs/kit",), ("svelte.config.{ts,js,mjs,cjs,mts}",), ("src/routes/**", "svelte.config.{ts,js,mjs,cjs,mts}", "src/hooks.{client,server}.{ts,js}", "src/service-worker.{ts,js}"), "production", (".svelte-kit/**", "build/**")),
    Pack("file-routing", ("@tanstack/react-router", "@tanstack/react-start", "@tanstack/solid-router", "@remix-run/react", "@remix-run/node", "remix", "expo-router", "@solidjs/start"), ("src/routes/**", "app/routes/**"),
         ("src/routes/**", "app/routes/**", "pages/**", "src/pages/**", "src/routeTree.gen.{ts,tsx}", "src/router.{ts,tsx,js}", "app/{client,server,router,ssr,entry.client,entry.server,root}.tsx"),
         "production", ("**/routeTree.gen.*",), beside=("react-router", "react-router-dom", "vue-router"), sure=True),
    Pack("root-config", (), (), (
        "content-collections.{ts,js}", "tailwind.config.{ts,js,mjs}", "postcss.config.{ts,js,cjs,mjs}", "drizzle.config.{ts,js}", "knexfile.{ts,js}", "tsup.config.{ts,js}", "rollup.config.{ts,js,mjs}",
        "esbuild.config.{ts,js}", "webpack.config.{ts,js}", "babel.config.{ts,js}", "release.config.{ts,js,mts}", "commitlint.config.{ts,js}", ".lintstagedrc.{ts,js}", "playwright.config.{ts,js}",
        "cypress.config.{ts,js}", "wrangler.config.ts", "eslint.config.{ts,js,mjs,cjs}", ".eslintrc.{js,cjs,mjs}", "prettier.config.{ts,js,mjs}", ".prettierrc.{js,cjs,mjs}", "i18n/request.{ts,js}",
        "sentry.{client,server,edge}.config.ts", "sentry.{client,server}.config.js"), "production", (".content-collections/**",), always=True),
    Pack("remix", ("@remix-run/dev", "remix"), (), (f"app/root.{_CODE}", "app/routes/**", f"app/entry.{{client,server}}.{_CODE}"), "production", ("build/**", ".cache/**"), sure=True),
    Pack("nx", ("nx",), ("nx.json",), (), "production", ("tmp/**", ".nx/**")),
    Pack("turborepo", ("turbo",), ("turbo.json",), (), "production", (), True),
    Pack("angular", ("@angular/core",), ("angular.json",), ("src/main.ts", "src/polyfills.ts", "src/app/app.module.ts", "src/app/app.component.ts"), "production", ("dist/**", ".angular/**")),
    Pack("rspack", ("@rspack/core",), (f"rspack.config.{_CONFIG}",), (f"rspack.config.{_CONFIG}", f"src/index.{_CODE}"), "production", ("dist/**",)),
    Pack("rsbuild", ("@rsbuild/core",), (f"rsbuild.config.{_CONFIG}",), (f"rsbuild.config.{_CONFIG}", f"src/index.{_CODE}"), "production", ("dist/**",)),
    Pack("rollup", ("rollup",), (f"rollup.config.{_CONFIG}",), (f"rollup.config.{_CONFIG}", f"src/index.{_CODE}"), "production", ("dist/**",), True),
    Pack("gatsby", ("gatsby",), (f"gatsby-config.{_CONFIG}",), (f"gatsby-{{config,node,browser,ssr}}.{_CONFIG}", "src/pages/**", "src/templates/**"), "production", (".cache/**", "public/**")),
    Pack("playwright", ("@playwright/test",), (f"playwright.config.{_CONFIG}",), (f"playwright.config.{_CONFIG}", "e2e/**/*.spec.*", "tests/**/*.spec.*"), "development", (), True),
    Pack("cypress", ("cypress",), (f"cypress.config.{_CONFIG}",), (f"cypress.config.{_CONFIG}", "cypress/support/*", "cypress/e2e/**"), "development", (), True),
    Pack("vitepress", ("vitepress",), (f".vitepress/config.{_CONFIG}",), (f".vitepress/config.{_CONFIG}", ".vitepress/theme/**"), "production", (".vitepress/dist/**", ".vitepress/cache/**"), True),
    Pack("docusaurus", ("@docusaurus/core",), (f"docusaurus.config.{_CONFIG}",), (f"docusaurus.config.{_CONFIG}", "src/pages/**", "src/theme/**"), "production", ("build/**", ".docusaurus/**")),
    Pack("trigger-dev", ("@trigger.dev/sdk",), (f"trigger.config.{_CONFIG}",), ("trigger.config.{ts,js,mts,mjs}", "trigger/**"), "production", (".trigger/**",)),
)


def from_root(path: Column, root: Column) -> Column:
    """A path from the folder ``root``; null for paths that aren't below it."""
    return F.when(root == "", path).when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, 1 << 20))


def _matching(path: Column, globs: dict[str, tuple[str, ...]]) -> Column:
    """The names whose globs a path fits."""
    return F.array_compact(F.array(*[F.when(path.rlike(any_glob(list(g), star_crosses=False)), F.lit(name)) for name, g in globs.items() if g] or [F.lit(None).cast("string")]))


def detections(files: DataFrame, manifests: DataFrame, *, packs: tuple[Pack, ...] = PACKS, toggles: dict[str, str] | None = None) -> DataFrame:
    """Rows (root, framework, confidence, by_dependency, by_config). files: rel_path, root. manifests: root, dependencies, devDependencies.

    Found by a dependency and by a configuration file a framework is ``exact``, by one of them ``heuristic`` (unless its pack is ``sure`` of a dependency). A toggle ``on`` gives it to every workspace, ``off`` to none.
    """
    toggles, packs = toggles or {}, tuple(p for p in packs if not p.always)
    maps = F.struct(F.coalesce(F.map_keys("dependencies"), F.array().cast("array<string>")).alias("d"), F.coalesce(F.map_keys("devDependencies"), F.array().cast("array<string>")).alias("v"))
    has = lambda p, deps: F.arrays_overlap(F.col("m.v") if p.dev_only else F.concat("m.d", "m.v"), F.array(*map(F.lit, deps)))
    said = lambda signal, rows: rows.select("root", "framework", F.lit(signal).alias("signal"))
    named = lambda signal, deps: said(signal, manifests.select("root", maps.alias("m")).select("root", F.explode(F.array_compact(F.array(*[F.when(has(p, deps(p)), F.lit(p.name)) for p in packs if deps(p)] or [F.lit(None).cast("string")]))).alias("framework")))
    own = files.select("root", from_root(F.col("rel_path"), F.col("root")).alias("path")).where("path is not null")
    by_config = said("config", own.select("root", F.explode(_matching(F.col("path"), {p.name: p.configs for p in packs})).alias("framework")))
    switched = said("switch", manifests.select("root", F.explode(F.array(*[F.lit(n) for n, t in toggles.items() if t == "on"]).cast("array<string>")).alias("framework")))
    rows = named("dependency", lambda p: p.dependencies).unionByName(named("beside", lambda p: p.beside)).unionByName(by_config).unionByName(switched)
    rows = rows.where(~F.col("framework").isin([n for n, t in toggles.items() if t == "off"]))
    by = lambda s: F.bool_or(F.col("signal") == s)
    found = rows.groupBy("root", "framework").agg(by("dependency").alias("by_dependency"), by("config").alias("by_config"), by("beside").alias("__beside"), by("switch").alias("__switch"))
    alone = ~F.col("framework").isin([p.name for p in packs if p.beside])
    found = found.where(F.col("by_dependency") | F.col("__switch") | (F.col("by_config") & (alone | F.col("__beside"))))
    exact = F.col("by_dependency") & (F.col("by_config") | F.col("framework").isin([p.name for p in packs if p.sure]))
    return found.select("root", "framework", "by_dependency", "by_config", F.when(exact, "exact").otherwise("heuristic").alias("confidence"))


def _contributed(found: DataFrame, files: DataFrame, globs: dict[str, tuple[str, ...]], packs: tuple[Pack, ...]) -> DataFrame:
    own = files.select("rel_path", "root", from_root(F.col("rel_path"), F.col("root")).alias("__p")).where("__p is not null")
    each = own.select("rel_path", "root", F.explode(_matching(F.col("__p"), globs)).alias("framework"))
    always = F.col("framework").isin([p.name for p in packs if p.always])
    met = found.select("root", "framework").distinct().withColumn("__met", F.lit(True))
    return each.join(met, ["root", "framework"], "left").where(always | F.col("__met")).select("rel_path", "root", "framework")


def framework_entries(found: DataFrame, files: DataFrame, *, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """Rows (path, kind, profile, framework) of the files that the frameworks found make entry points."""
    profile = F.create_map(*[x for p in packs for x in (F.lit(p.name), F.lit(p.profile))])
    rows = _contributed(found, files, {p.name: p.entries for p in packs}, packs)
    return rows.select(F.col("rel_path").alias("path"), F.lit("framework-pack").alias("kind"), profile[F.col("framework")].alias("profile"), "framework").distinct()


def generated_files(found: DataFrame, files: DataFrame, *, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """Rows (path, framework) of the files that the frameworks found generate."""
    return _contributed(found, files, {p.name: p.generated for p in packs}, packs).select(F.col("rel_path").alias("path"), "framework").distinct()


def trust_notes(found: DataFrame) -> DataFrame:
    """Rows (root, framework, note) where a framework was found by one signal only."""
    note = F.concat(F.col("framework"), F.when(F.col("by_dependency"), F.lit(" was found by a dependency only")).when(F.col("by_config"), F.lit(" was found by a configuration file only")).otherwise(F.lit(" was switched on")))
    return found.where("confidence = 'heuristic'").select("root", "framework", note.alias("note"))


def with_context(findings: DataFrame, found: DataFrame, files: DataFrame, subject: Column) -> DataFrame:
    """``findings`` with ``frameworks``, the sorted names of those found in the workspace of the subject's file. files: rel_path, root."""
    names = found.groupBy("root").agg(F.sort_array(F.collect_set("framework")).alias("__names"))
    homes = files.select(F.col("rel_path").alias("__path"), "root").join(names, "root").select("__path", "__names")
    out = findings.join(homes, subject == F.col("__path"), "left")
    return out.withColumn("frameworks", F.coalesce("__names", F.array().cast("array<string>"))).drop("__path", "__names")
