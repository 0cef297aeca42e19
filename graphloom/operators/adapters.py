"""Configuration files of tools as rows: what each key of each file means, held against the flattened files by an equi join.

A file is parsed once and taken apart in the same pass, one row a leaf with its path of keys (``[]`` for a place in a list). A rule
says of a tool's file what a leaf is an input of: an entry point, a setup file, a test pattern, an alias, a package, a source root, an
ignored pattern. Rules meet leaves on the file's name and the path's first key, so another tool is another row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import dependency_name
from graphloom.operators.resolve import normalised
from graphloom.operators.tables import in_batches
from graphloom.sources.repo import without_comments

#: Levels of keys that are followed.
LEVELS = 7
# A tool's files (or its key in the package manifest), and which keys hold which kind of input. ``*`` is one key, ``[]`` a place in a list.
TOOLS = {
    "angular": (("angular.json",), None, {"entry": ["projects.*.architect.*.options.main", "projects.*.architect.*.options.browser", "projects.*.architect.*.options.server"], "setup": ["projects.*.architect.*.options.polyfills", "projects.*.architect.*.options.polyfills.[]"], "package": ["projects.*.architect.*.builder"]}),
    "ava": ((), "ava", {"test": ["files.[]"], "setup": ["require.[]"]}),
    "babel": ((".babelrc", ".babelrc.json", "babel.config.json"), "babel", {"package": ["presets.[]", "presets.[].[]", "plugins.[]", "plugins.[].[]"], "alias": ["plugins.[].[].alias.*"]}),
    "changesets": (("config.json",), None, {"ignore": ["ignore.[]"], "package": ["changelog", "changelog.[]"]}),
    "commitlint": ((".commitlintrc.json", "commitlint.config.json"), "commitlint", {"package": ["extends", "extends.[]", "plugins.[]"]}),
    "cypress": (("cypress.json",), None, {"entry": ["pluginsFile"], "setup": ["supportFile"], "root": ["integrationFolder", "componentFolder"], "test": ["testFiles", "testFiles.[]"]}),
    "drizzle": (("drizzle.config.json",), None, {"entry": ["schema", "schema.[]"], "ignore": ["out"]}),
    "electron": ((), "build", {"entry": ["extraMetadata.main"], "package": ["extends"]}),
    "eslint": ((".eslintrc", ".eslintrc.json"), "eslintConfig", {"package": ["parser", "extends", "extends.[]", "plugins.[]", "overrides.[].parser", "overrides.[].extends", "overrides.[].extends.[]", "overrides.[].plugins.[]"]}),
    "husky": ((), "husky", {"command": ["hooks.*"]}),
    "jest": (("jest.config.json",), "jest", {"alias": ["moduleNameMapper.*"], "setup": ["setupFiles.[]", "setupFilesAfterEnv.[]", "globalSetup", "globalTeardown"], "test": ["testMatch.[]"], "root": ["roots.[]"], "package": ["preset", "testEnvironment", "transform.*", "reporters.[]"]}),
    "lerna": (("lerna.json",), None, {"root": ["packages.[]"]}),
    "lint-staged": ((".lintstagedrc.json",), "lint-staged", {"command": ["*", "*.[]"]}),
    "mocha": ((".mocharc.json",), "mocha", {"test": ["spec", "spec.[]"], "setup": ["file", "file.[]"], "package": ["require", "require.[]"]}),
    "nx": (("nx.json", "project.json"), None, {"entry": ["targets.*.options.main"], "package": ["plugins.[]", "plugins.[].plugin", "targets.*.executor"]}),
    "parcel": ((".parcelrc",), None, {"package": ["extends", "extends.[]", "transformers.*.[]", "resolvers.[]"]}),
    "parcel-targets": ((), "targets", {"entry": ["*.source", "*.source.[]"]}),
    "postcss": ((".postcssrc.json",), "postcss", {"package-key": ["plugins.*", "plugins.*.*"]}),
    "prettier": ((".prettierrc", ".prettierrc.json"), "prettier", {"package": ["", "plugins.[]"]}),
    "prisma": ((), "prisma", {"command": ["seed"]}),
    "swc": ((".swcrc",), None, {"alias": ["jsc.paths.*.[]"], "package": ["jsc.experimental.plugins.[].[]"]}),
    "tsup": (("tsup.config.json",), "tsup", {"entry": ["entry.[]", "entry.*"], "package": ["external.[]"]}),
    "turborepo": (("turbo.json",), None, {"ignore": ["globalDependencies.[]"], "root": ["tasks.*.inputs.[]", "pipeline.*.inputs.[]"]}),
    "typedoc": (("typedoc.json",), "typedocOptions", {"entry": ["entryPoints.[]"], "ignore": ["exclude.[]"], "package": ["plugin.[]"]}),
    "vue": ((), "vue", {"entry": ["pages.*", "pages.*.entry"]}),
}
FILES = sorted({f for files, _, _ in TOOLS.values() for f in files} | {"package.json"})


def rule_rows() -> list[tuple[str, str, str, str, str, str]]:
    """(tool, file, head, key, regex, kind): ``head`` is the first key of a leaf's path, ``*`` for any."""
    out = []
    for tool, (files, member, kinds) in TOOLS.items():
        for kind, keys in kinds.items():
            for key in keys:
                for file, path in [*((f, key) for f in files), *([("package.json", ".".join(x for x in (member, key) if x))] if member else [])]:
                    if path:
                        parts = path.split(".")
                        regex = "^" + "\u0001".join("[^\u0001]*" if p == "*" else "\\[\\]" if p == "[]" else p for p in parts) + "$"
                        out.append((tool, file, parts[0], path, regex, kind))
    return out


class _Number(str):
    """A number as it is written."""


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len(out := dict(pairs)) < len(pairs):
        raise ValueError("a key that stands twice")
    return out


def _refused(name: str) -> None:
    raise ValueError(name)


_JSON = json.JSONDecoder(object_pairs_hook=_once, parse_float=_Number, parse_int=_Number, parse_constant=_refused)


def _parsed(text: str | None) -> object:
    try:
        return _JSON.raw_decode(without_comments(text or "").lstrip(" \t\r\n"))[0]
    except (ValueError, RecursionError):
        return None


def _scalars(value: object, keys: tuple[str, ...] = ()) -> Iterator[tuple[list[str], str]]:
    """(keys, scalar as JSON) of the scalars in a value, down to ``LEVELS`` keys."""
    if isinstance(value, (dict, list)):
        for key, part in (value.items() if isinstance(value, dict) else (("[]", p) for p in value)) if len(keys) < LEVELS else ():
            yield from _scalars(part, (*keys, key.encode("utf-8", "replace").decode()))
    elif keys:
        yield list(keys), value if isinstance(value, _Number) else json.dumps(value)


def leaves(files: DataFrame) -> DataFrame:
    """(rel_path, keys, value) of every scalar in JSON files (rel_path, text), comments and trailing commas allowed; what is no JSON has none.

    A leaf's row holds its own scalar only: parts of a VARIANT would each carry all keys of their file.
    """
    schema = pa.schema([("rel_path", pa.string()), ("keys", pa.list_(pa.string())), ("scalar", pa.string())])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return in_batches(((path, *leaf) for path, text in texts for leaf in _scalars(_parsed(text))), schema)

    found = files.select("rel_path", "text").repartition("rel_path").mapInArrow(flat, "rel_path string, keys array<string>, scalar string")
    return found.select("rel_path", "keys", F.try_variant_get(F.try_parse_json("scalar"), "$", "string").alias("value"))


def config_inputs(rows: DataFrame, rules: list[tuple[str, str, str, str, str, str]] | None = None) -> DataFrame:
    """(root, rel_path, tool, kind, key, value) of the tools' files among rows (rel_path, text): root is the file's folder, key the last key that isn't a place in a list."""
    spark: SparkSession = rows.sparkSession
    table = spark.createDataFrame(rules or rule_rows(), "tool string, file string, head string, rule_key string, regex string, kind string")
    name = F.substring_index("rel_path", "/", -1)
    own = rows.where(name.isin(*FILES) & ((name != "config.json") | F.col("rel_path").rlike(r"(^|/)\.changeset/config\.json$")))
    flat = leaves(own).select("rel_path", "keys", "value", name.alias("file"), F.explode(F.array_distinct(F.array(F.col("keys")[0], F.lit("*")))).alias("head"), F.array_join("keys", "\u0001").alias("path"))
    met = flat.join(F.broadcast(table), ["file", "head"]).where(F.expr("path rlike regex"))  # a fixed table
    last = F.element_at(F.filter("keys", lambda k: k != "[]"), -1)
    # A map of plugins names them by its keys.
    named = F.when(F.col("kind") == "package-key", F.get("keys", F.array_position("keys", "plugins").cast("int"))).otherwise(F.col("value"))
    kind = F.when(F.col("kind") == "package-key", "package").otherwise(F.col("kind"))
    root = F.regexp_replace(F.regexp_replace("rel_path", r"/?[^/]*$", ""), r"(^|/)\.changeset$", "")
    return met.select(root.alias("root"), "rel_path", "tool", kind.alias("kind"), last.alias("key"), named.alias("value")).where("value is not null").distinct()


def tool_aliases(inputs: DataFrame) -> DataFrame:
    """(prefix, target, scope, origin) of the aliases that tools' configurations name, for files below the configuration's folder, which targets start from.

    A test runner's expression is read where it is a prefix with one group at its end; others stay as they are written and fit no specifier.
    """
    cut: Column = F.regexp_replace(F.regexp_replace("key", r"^\^|\$$", ""), r"/\(\.[*+]\)$", "")
    mapped = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "^<rootDir>$", "."), "^<rootDir>/", ""), r"/\$1$", "")
    plain = lambda c: F.regexp_replace(c, r"/\*$", "")
    runner = F.col("tool") == "jest"
    rows = inputs.where("kind = 'alias' and value <> ''").select("root", F.when(runner, cut).otherwise(plain("key")).alias("prefix"), F.when(runner, mapped).otherwise(plain("value")).alias("target"), F.when(F.col("tool") == "babel", "Babel").otherwise("TsconfigPaths").alias("origin"))
    return rows.where("prefix <> ''").select("prefix", normalised(F.concat_ws("/", "root", "target")).alias("target"), F.col("root").alias("scope"), "origin").distinct()


def packages(inputs: DataFrame) -> DataFrame:
    """(root, dep) of the packages that configurations name: by name, by the short forms of presets and plugins, or as a word of a command."""
    named = inputs.where("kind = 'package'").select("root", "tool", F.regexp_replace("value", "^(module|plugin):", "").alias("value")).where("not value rlike '^[./]|^<'")
    short = F.regexp_replace("value", "/.*$", "")
    long = (
        F.when((F.col("tool") == "babel"), F.array("value", F.concat(F.lit("babel-plugin-"), "value"), F.concat(F.lit("babel-preset-"), "value")))
        .when(F.col("tool") == "eslint", F.array("value", F.concat(F.lit("eslint-plugin-"), short), F.concat(F.lit("eslint-config-"), short), F.concat("value", F.lit("/eslint-plugin")), F.concat("value", F.lit("/eslint-config"))))
        .when(F.col("tool") == "jest", F.array("value", F.concat(F.lit("jest-environment-"), "value")))
        .when(F.col("tool") == "commitlint", F.array("value", F.concat(F.lit("commitlint-config-"), "value")))
        .otherwise(F.array("value"))
    )
    names = named.select("root", F.explode(long).alias("value")).select("root", dependency_name(F.regexp_replace("value", ":.*$", "")).alias("dep"))
    words = inputs.where("kind = 'command'").select("root", F.explode(F.split("value", r"[\s&|;]+")).alias("dep")).where("dep <> ''")
    return names.unionByName(words).where("dep is not null").distinct()
