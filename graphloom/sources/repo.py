"""Readers of repositories: inventories, manifests, owners, configurations, changes, baselines."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import file_role, source_kind
from graphloom.functions.globs import any_glob
from graphloom.operators.paths import canonical_paths

SKIPPED = r"(^|/)(\.git|node_modules|target)/"
MANIFEST = "name string, version string, private boolean, main string, module string, types string, typings string, bin string, browser string, workspaces string, exports string, imports string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>"
# The kinds of declared dependencies.
DEPENDENCY_MAPS = {"dependencies": "dependency", "devDependencies": "dev dependency", "peerDependencies": "peer dependency", "optionalDependencies": "optional dependency"}


#: Names of which a walk reads contents.
NAMES = "{*.ts,*.tsx,*.mts,*.cts,*.js,*.jsx,*.mjs,*.cjs,*.vue,*.svelte,*.astro,*.mdx,*.json,*.yaml,*.css,*.scss,*.sass,*.less,*.styl,CODEOWNERS,.gitignore}"


def tracked(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return source_kind(path).isNotNull() | name.isin("package.json", "tsconfig.json", "tsconfig.base.json") | (name.endswith(".json") & (name.contains("config") | name.contains("schema")))


# Files that are no sources, but tell of owners, styles, workspaces and what to leave out.
AUXILIARY = ["CODEOWNERS", "pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "angular.json", "project.json", "typedoc.json", "cypress.json", ".gitignore"]
#: Hidden files that a walk looks for in every folder; others that are hidden, or lie in hidden folders, are no part of it.
HIDDEN = (".gitignore", ".github/CODEOWNERS", ".babelrc", ".babelrc.json", ".eslintrc", ".eslintrc.json", ".prettierrc", ".prettierrc.json", ".postcssrc.json", ".commitlintrc.json", ".lintstagedrc.json", ".swcrc", ".mocharc.json", ".parcelrc", ".changeset/config.json")
STYLES = r"\.(css|scss|sass|less|styl)$"


def auxiliary(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(*AUXILIARY) | path.rlike(STYLES)


def hidden_files(spark: SparkSession, root: str, names: list[str], wanted: tuple[str, ...] = HIDDEN) -> list[tuple[str, str]]:
    """(path, text) of the hidden files ``wanted`` in the folders above ``names``: rules for the walk itself, a few small files."""
    base = root.rstrip("/")
    cut = base.removeprefix("file://") + "/"
    folders = {""}
    for name in names:
        at = name.rpartition(cut)[2].rpartition("/")[0]
        while at and at not in folders:
            folders.add(at)
            at = at.rpartition("/")[0]
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    path = jvm.org.apache.hadoop.fs.Path
    odd = {f for f in folders if re.search(r"[\\{}\[\]*?,^]", f)}  # a glob can't name these
    plain, out = sorted(folders - odd), []
    for file in wanted:
        found = [at for f in sorted(odd) if fs.exists(at := path(f"{base}/{f}/{file}"))]
        for k in range(0, len(plain), 200):
            inside = ",".join(f"{f}/" if f else "./" for f in plain[k : k + 200])
            found += [status.getPath() for status in fs.globStatus(path(f"{base}/{{{inside}}}{file}")) or []]
        for at in found:
            stream = fs.open(at)
            out.append((at.toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return sorted(set(out))


def symlinks(spark: SparkSession, root: str) -> DataFrame:
    """(path, target) of the symbolic links below a mounted folder, not followed; targets within the folder are relative to it or to their link. Object stores have none."""
    base = os.path.realpath(root.removeprefix("file://"))
    out = []
    for folder, folders, names in os.walk(base):
        for at in (os.path.join(folder, n) for n in [*folders, *names]):
            if os.path.islink(at):
                to, rel = os.readlink(at), os.path.relpath(at, base)
                inside = os.path.isabs(to) and os.path.commonpath([base, os.path.normpath(to)]) == base
                out.append((rel, os.path.relpath(to, os.path.dirname(at)) if inside else to))
    return spark.createDataFrame(sorted(out), "path string, target string")


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None, *, gitignore: bool = True, links: DataFrame | None = None) -> DataFrame:
    """Rows (rel_path, text) of a tree's tracked and auxiliary files, less those that ``ignore`` or the tree's ``.gitignore`` files take out.

    Only files of such names are listed with their contents; what is taken out is decided on paths and the texts of the ``.gitignore`` files.
    Spark's listing follows links: with ``links`` (see ``symlinks``), what it found through them is left out, as it is another path of something else.
    """
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", NAMES).load(root)
    rel = F.substring_index(F.col("path"), base.removeprefix("file://"), -1)
    rows = found.select(rel.alias("rel_path"), F.col("content").cast("string").alias("text"))
    # Spark reads no empty and no hidden files, but its own listing has the former, and tells the folders in which to look for the latter.
    names = [unquote(f) for f in found.inputFiles()]
    listed = spark.createDataFrame([(f,) for f in names], "path string").select(rel.alias("rel_path"))
    rows = rows.unionByName(listed.join(rows.select("rel_path"), "rel_path", "left_anti").withColumn("text", F.lit("")))
    hidden = hidden_files(spark, root, names)
    rows = rows.unionByName(spark.createDataFrame(hidden, "path string, text string").select(rel.alias("rel_path"), "text"))
    asked = tracked(F.col("rel_path")) | auxiliary(F.col("rel_path")) | F.substring_index("rel_path", "/", -1).isin([h.rpartition("/")[2] for h in HIDDEN])
    rows = rows.where(~F.col("rel_path").rlike(SKIPPED) & asked)
    rows = rows.where(~F.col("rel_path").rlike(any_glob(ignore))) if ignore else rows
    if links is not None:
        rows = rows.join(canonical_paths(rows.select(F.col("rel_path").alias("path")), links).where("outcome <> 'plain'"), F.col("rel_path") == F.col("path"), "left_anti")
    if gitignore:
        from graphloom.sources.ignore import ignored, ignore_rules

        out = ignored(rows.select("rel_path"), ignore_rules(rows.where(F.substring_index("rel_path", "/", -1) == ".gitignore")))
        rows = rows.join(out, "rel_path", "left_anti")
    return rows


def inventory(rows: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """``rows`` (rel_path, ...) with kind, role and the workspace whose root is the longest prefix."""
    out = rows.withColumn("source_kind", source_kind(F.col("rel_path"))).withColumn("role", file_role(F.col("rel_path")))
    if workspaces is None:
        return out
    # Every folder above a folder with files is looked up: an equi join, however many workspaces there are, and files meet their folder only.
    parts = F.split("rel_path", "/")
    out = out.withColumn("__at", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    above = F.split("__at", "/")
    folders = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(above)), lambda k: F.array_join(F.slice(above, 1, k), "/")))
    near = out.select("__at").distinct().select("__at", F.explode(F.array_distinct(folders)).alias("root")).join(workspaces.select("root", "workspace"), "root").groupBy(F.col("__at").alias("__r")).agg(F.max_by("workspace", F.length("root")).alias("workspace"))
    return out.join(near, F.col("__at") == F.col("__r"), "left").drop("__at", "__r")


def manifests(rows: DataFrame) -> DataFrame:
    """Rows (root, manifest) of package manifests among (rel_path, text)."""
    own = rows.where(F.col("rel_path").rlike(r"(^|/)package\.json$"))
    return own.select(F.regexp_replace("rel_path", r"/?package\.json$", "").alias("root"), F.from_json("text", MANIFEST).alias("m")).select("root", "m.*")


def declared(found: DataFrame) -> DataFrame:
    """Rows (root, dep, dep_kind)."""
    parts = [found.select("root", F.explode(F.map_keys(c)).alias("dep"), F.lit(kind).alias("dep_kind")) for c, kind in DEPENDENCY_MAPS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def workspace_globs(pnpm: list[str] | None, npm: list[str] | None, lerna: list[str] | None) -> list[str]:
    """The first source that names any."""
    return pnpm or npm or lerna or []


def pnpm_packages(text: str) -> list[str]:
    """Globs of the list below ``packages:``."""
    out, inside = [], False
    for line in text.splitlines():
        body = line.strip()
        if body and not line[0].isspace() and not body.startswith("-"):
            inside = body.startswith("packages:")
        elif inside and body.startswith("-"):
            out.append(body[1:].strip().strip("'\""))
    return out


def codeowners(text: str) -> list[tuple[str, str]]:
    """(pattern, first owner) in order; comments and lines without owners are skipped."""
    rows = [line.split("#")[0].split() for line in text.splitlines()]
    return [(r[0], r[1]) for r in rows if len(r) >= 2]


def changes(lines: DataFrame) -> DataFrame:
    """Rows (status, path, from_path) of name-status lines in the column ``value``."""
    p = F.split("value", "\t")
    status = F.substring(p[0], 1, 1)
    moved = status.isin("R", "C")
    named = F.when(status == "A", "added").when(status.isin("M", "T"), "modified").when(status == "D", "deleted").when(status == "R", "renamed").when(status == "C", "added")
    return lines.where(F.size(p) >= 2).select(named.alias("status"), F.when(moved, F.try_element_at(p, F.lit(3))).otherwise(p[1]).alias("path"), F.when(status == "R", p[1]).alias("from_path")).where("status is not null")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a saved report."""
    return spark.read.option("multiLine", True).schema("findings array<struct<id:string>>").json(path).select(F.explode("findings.id").alias("id"))


def without_comments(text: str) -> str:
    """JSON without // and /* */ comments and trailing commas, strings untouched."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = n if (j := text.find("\n", i)) < 0 else j
        elif text.startswith("/*", i):
            i = n if (j := text.find("*/", i + 2)) < 0 else j + 2
        else:
            out.append(c)
            i += 1
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", "".join(out))
