"""What configuration files of a repository tell: workspaces, path aliases, packages that configurations and style sheets use."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import dependency_name
from graphloom.functions.globs import any_glob
from graphloom.operators.tables import shuffled
from graphloom.sources.repo import STYLES, pnpm_packages, without_comments, workspace_globs

# Configurations whose ``extends`` names packages, style sheets, and places of code owners' files in order.
EXTENDING = ["tsconfig.json", "tsconfig.build.json", "tsconfig.app.json", "tsconfig.node.json", "tsconfig.lib.json"]
OWNER_FILES = ["CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS"]
MARKERS = [".git", "pnpm-workspace.yaml", "package.json"]


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def project_root(start: str, markers: list[str] | None = None) -> str | None:
    """The nearest folder from ``start`` upwards that has a marker file; for the driver's own command line."""
    at = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in markers or MARKERS):
            return at
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def discovered(manifests: DataFrame, globs: list[str]) -> DataFrame:
    """Rows (root, workspace) of manifests (root, name): the repository's own and those whose folder fits a workspace glob; without globs only the own one."""
    yes = [g.strip("/").removeprefix("./") for g in globs if not g.startswith("!")]
    no = [g[1:].strip("/").removeprefix("./") for g in globs if g.startswith("!")]
    inside = F.col("root").rlike(any_glob(yes, star_crosses=False)) & ~F.col("root").rlike(any_glob(no, star_crosses=False))
    return manifests.where((F.col("root") == "") | inside).select("root", F.coalesce("name", "root").alias("workspace")).distinct()


def declared_globs(rows: DataFrame) -> list[str]:
    """The workspace globs that the repository itself names: those of pnpm, of the root manifest or of lerna."""
    names = ["pnpm-workspace.yaml", "package.json", "lerna.json"]
    found = {r["rel_path"]: r["text"] for r in rows.where(F.col("rel_path").isin(*names)).select("rel_path", "text").collect()}  # three rows at most

    def listed(name: str, *keys: str) -> list[str]:
        value = _json(found.get(name))
        for key in keys:
            value = value.get(key) if isinstance(value, dict) and key in value else value
        return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []

    return workspace_globs(pnpm_packages(found.get("pnpm-workspace.yaml") or ""), listed("package.json", "workspaces", "packages"), listed("lerna.json", "packages"))


def owner_rules(rows: DataFrame) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of the first code owners' file there is, of rows (rel_path, text)."""
    found = {r["rel_path"]: r["text"] for r in rows.where(F.col("rel_path").isin(*OWNER_FILES)).select("rel_path", "text").collect()}  # three rows at most
    text = next((found[p] for p in OWNER_FILES if p in found), "")
    lines = [line.split() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]
    return [(w[0], w[1:]) for w in lines if len(w) >= 2]


def _json(text: str | None) -> object:
    try:
        return json.loads(without_comments(text or ""))
    except ValueError:
        return None


def config_status(rows: DataFrame) -> DataFrame:
    """Rows (rel_path, status) of JSON configurations: ``ok``, or ``invalid`` for what is no JSON even without comments and trailing commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["invalid" if _json(t) is None else "ok" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["rel_path", "status"])

    own = rows.where(F.col("rel_path").rlike(r"(^|/)(package|[jt]sconfig[^/]*|[^/]*config|[^/]*schema)\.json$"))
    return own.select("rel_path", "text").mapInArrow(run, "rel_path string, status string")


def tsconfig_aliases(rows: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Rows (prefix, target, scope, origin) of the ``paths`` of the workspaces' tsconfig.json; of several targets the first counts.

    ``scope`` is the workspace's folder, or null where all workspaces that have the prefix agree on its target.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                options = config.get("compilerOptions") if isinstance(config := _json(text), dict) else None
                options = options if isinstance(options, dict) else {}
                base = options.get("baseUrl") if isinstance(options.get("baseUrl"), str) else "."
                paths = options.get("paths") if isinstance(options.get("paths"), dict) else {}
                for pattern, targets in paths.items():
                    if isinstance(targets, list) and targets and isinstance(targets[0], str):
                        target = os.path.normpath(os.path.join(root or ".", base, targets[0].removesuffix("/*"))).replace("\\", "/")
                        out.append((pattern.removesuffix("/*"), "" if target == "." else target, root))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["prefix", "target", "scope"])

    own = rows.where(F.col("rel_path").rlike(r"(^|/)tsconfig\.json$")).select(folder(F.col("rel_path")).alias("root"), "text")
    found = own.join(workspaces.select("root"), "root", "left_semi").select("root", "text").mapInArrow(run, "prefix string, target string, scope string")
    agreed = found.groupBy("prefix").agg(F.count_distinct("target").alias("__n"))
    scope = F.when(F.col("__n") > 1, F.col("scope")).alias("scope")
    return found.join(agreed, "prefix").select("prefix", "target", scope, F.lit("TsconfigPaths").alias("origin")).distinct()


def extended_packages(rows: DataFrame) -> DataFrame:
    """Rows (root, dep) of the packages that tsconfig files extend."""
    either = F.coalesce(F.from_json(F.get_json_object("text", "$.extends"), "array<string>"), F.array(F.get_json_object("text", "$.extends")))
    own = rows.where(F.substring_index("rel_path", "/", -1).isin(*EXTENDING))
    names = own.select(folder(F.col("rel_path")).alias("root"), F.explode(F.array_compact(either)).alias("spec"))
    return names.where("spec not like '.%'").select("root", dependency_name(F.col("spec")).alias("dep")).where("dep is not null").distinct()


def style_packages(rows: DataFrame) -> DataFrame:
    """Rows (rel_path, dep) of the packages that style sheets import or use."""
    own = rows.where(F.col("rel_path").rlike(STYLES) & ~F.col("rel_path").rlike(r"(^|/)(node_modules|dist)/"))
    line = F.explode(F.split("text", r"\r?\n")).alias("line")
    spec = F.regexp_extract(F.trim("line"), r"""^@(?:import|use)[^"']*["']([^"']*)["']""", 1)
    found = own.select("rel_path", line).select("rel_path", spec.alias("spec")).where(~F.col("spec").rlike(r"^(\.|/|http)") & (F.col("spec") != ""))
    return found.select("rel_path", F.regexp_extract("spec", r"^(@[^/]*/[^/]*|[^/]+)", 1).alias("dep")).where("dep <> ''").distinct()


def glob_rows(patterns: DataFrame) -> DataFrame:
    """``patterns`` (src, glob) with base (the folder that the glob is below, from the repository's root), head (the text that all its paths begin with), regex and negated."""
    from graphloom.functions.globs import glob_regex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for src, glob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = glob.removeprefix("!")
                whole = body.lstrip("/") if body.startswith("/") else os.path.normpath(os.path.join(os.path.dirname(src), body))
                fixed = re.split(r"[*?{\[]", whole, maxsplit=1)[0]
                out.append((src, glob, fixed.rpartition("/")[0], fixed, glob_regex(whole, star_crosses=False), glob.startswith("!")))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 5 + [pa.bool_()], strict=True)], ["src", "glob", "base", "head", "regex", "negated"])

    return patterns.select("src", "glob").distinct().mapInArrow(run, "src string, glob string, base string, head string, regex string, negated boolean")


def literal_head(regex: str) -> str:
    """Text that begins all that an expression finds; empty where it isn't tied to the start or that can't be told."""
    loose = re.sub(r"\\.", "", regex, flags=re.S)
    depth = 0
    for c in loose if "|" in loose else "":
        depth += (c == "(") - (c == ")")
        if "[" in loose or (c == "|" and depth <= 0):
            return ""
    out, i = [], 1
    while regex[:1] == "^" and i < len(regex):
        if regex[i] == "\\" and regex[i + 1 : i + 2].isascii() and not regex[i + 1 : i + 2].isalnum():
            i += 1
        elif regex[i] in ".^$*+?()[]{}|\\":
            break
        if i >= len(regex) or regex[i + 1 : i + 2] in ("*", "+", "?", "{"):
            break
        out.append(regex[i])
        i += 1
    return "".join(out)


def headed(asked: DataFrame) -> DataFrame:
    """``asked`` (regex, …) with the ``head`` of each expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regexes = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([literal_head(r) for r in regexes], pa.string())], ["regex", "head"])

    heads = asked.select("regex").distinct().mapInArrow(run, "regex string, head string")
    return asked.join(shuffled(heads), "regex")


def begun(asked: DataFrame, files: DataFrame, subject: Column) -> DataFrame:
    """``asked`` (base, deep, head, …) with each ``path`` below ``base`` (in its folders too, if ``deep``) whose ``subject`` (of base and path) begins with ``head``.

    A file gives one row for each length of head that is asked of a folder above it, so folders with many files and many expressions make no product.
    """
    lengths = asked.groupBy("base", "deep").agg(F.collect_set(F.length("head")).alias("lengths"))
    there = below(files).withColumn("deep", F.explode(F.when(F.col("base") == folder(F.col("path")), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    named = there.join(shuffled(lengths), ["base", "deep"]).withColumn("subject", subject)
    named = named.select("base", "deep", "path", "subject", F.explode("lengths").alias("n")).where("length(subject) >= n")
    return asked.join(shuffled(named.select("base", "deep", "path", "subject", F.expr("left(subject, n)").alias("head"))), ["base", "deep", "head"])


def below(files: DataFrame) -> DataFrame:
    """Rows (base, path): each file under every folder above it, for equi joins with folders."""
    parts = F.split("rel_path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.select(F.col("rel_path").alias("path"), F.explode(folders).alias("base"))
