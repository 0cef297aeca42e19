"""Declared packages that need no import: tools that commands and configurations run, and packages that another package needs beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Packages that are used by tools, never by imports.
TOOLS = (
    "typescript", "postcss", "autoprefixer", "tailwindcss", "@tailwindcss/typography", "@tailwindcss/forms", "@tailwindcss/container-queries", "@tailwindcss/vite", "@tailwindcss/postcss",
    "cssnano", "sass", "less", "lightningcss", "@vitejs/plugin-react", "@vitejs/plugin-react-swc", "@vitejs/plugin-vue", "vite-tsconfig-paths", "vite-plugin-dts", "@tanstack/config",
    "@tanstack/router-plugin", "@tanstack/router-vite-plugin", "@content-collections/core", "@content-collections/vite", "@content-collections/next", "@next/bundle-analyzer",
    "@sentry/esbuild-plugin", "@sentry/nextjs", "esbuild", "swc", "@swc/core", "@swc/cli", "terser", "rollup", "webpack", "webpack-cli", "webpack-dev-server", "vitest", "mocha", "ava", "tape",
    "uvu", "jest", "@playwright/test", "playwright", "cypress", "@cypress/code-coverage", "c8", "nyc", "istanbul", "@vitest/browser", "@vitest/ui", "@vitest/coverage-v8",
    "@vitest/coverage-istanbul", "jsdom", "happy-dom", "@testing-library/jest-dom", "eslint", "prettier", "stylelint", "oxlint", "biome", "@biomejs/biome", "lint-staged", "husky",
    "simple-git-hooks", "lefthook", "tsx", "ts-node", "tsm", "nodemon", "concurrently", "wait-on", "npm-run-all", "npm-run-all2", "cross-env", "dotenv-cli", "env-cmd", "rimraf", "del-cli",
    "shx", "turbo", "lerna", "tsup", "tsdown", "unbuild", "typedoc", "jsdoc", "publint", "@arethetypeswrong/cli", "changesets", "@changesets/cli", "@changesets/changelog-github",
    "standard-version", "release-it", "np", "semantic-release", "vibe-rules", "autocannon", "@platformatic/flame",
)
# Names of plugins, presets, parsers and loaders of tools.
TOOL_NAMES = (
    "^@types/", "^@eslint/", "^@eslint-react/", "^eslint-plugin-", "^eslint-config-", "^@next/eslint-plugin-", "^@typescript-eslint/", "(eslint|vue|babel).*-parser$", "^prettier-plugin-",
    "/prettier-plugin-", "^@storybook/", "^@opentelemetry/", "^babel-plugin-", "^@babel/plugin-", "^@babel/preset-", "^postcss-", "^rollup-plugin-", "^@rollup/plugin-", "-loader$",
    "^webpack-", "^stylelint-", "^@commitlint/", "^commitlint-", "^@semantic-release/", "^semantic-release-",
)
# Packages that are needed where one of others is declared.
NEEDED_BY = {
    "react-dom": ("react", "next", "@tanstack/react-start"),
    "react": ("react-dom", "next", "@tanstack/react-start", "@tanstack/react-router"),
    "solid-js": ("@solidjs/router", "@tanstack/solid-router", "@tanstack/solid-start"),
    "vue": ("@tanstack/vue-router", "nuxt", "@tanstack/vue-start", "@vitejs/plugin-vue"),
    "svelte": ("@sveltejs/kit",),
    "isbot": ("@tanstack/react-start", "@tanstack/solid-start", "@tanstack/vue-start", "@tanstack/react-router", "@tanstack/solid-router", "@tanstack/vue-router"),
}


def exempt(declared: DataFrame) -> DataFrame:
    """Distinct rows (root, dep, reason) of ``declared`` (root, dep, dep_kind) that no import has to use: ``tool``, or ``needed by`` the least of the packages that need it.

    Optional dependencies need nothing beside them. A package that is both is a tool.
    """
    rows = declared.select("root", "dep", "dep_kind").where("dep is not null")
    tool = F.col("dep").isin(*TOOLS) | F.col("dep").rlike("|".join(TOOL_NAMES))
    tools = rows.where(tool).select("root", "dep", F.lit("tool").alias("reason"))
    needs = F.create_map(*[x for dep, by in NEEDED_BY.items() for x in (F.lit(dep), F.array(*map(F.lit, by)))])
    asks = rows.where(~tool & F.col("dep").isin(*NEEDED_BY)).select("root", "dep", F.explode(needs[F.col("dep")]).alias("__by"))
    there = rows.where("dep_kind <> 'optional dependency'").select("root", F.col("dep").alias("__by"))
    needed = asks.join(there, ["root", "__by"]).groupBy("root", "dep").agg(F.concat(F.lit("needed by "), F.min("__by")).alias("reason"))
    return tools.unionByName(needed).distinct()
