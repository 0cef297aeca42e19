"""Entry points: what manifests, scripts, conventions and configuration name as the roots of a repository's graph."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import file_role
from graphloom.functions.globs import any_glob
from graphloom.operators.manifests import leaves
from graphloom.operators.resolve import merged_entries, normalised
from graphloom.operators.tables import dealt, in_batches, shuffled

# Files that are entry points by their names, folders of build output and of formats in them, and suffixes of their sources.
CONVENTIONS = ["src/index.ts", "src/index.tsx", "src/index.js", "src/index.jsx", "src/main.ts", "src/main.tsx", "src/main.js", "src/main.jsx", "index.ts", "index.js"]
OUTPUT, FORMATS = "(dist|build|out|lib)", "(esm|cjs|source|types)"
SOURCE_SUFFIXES = ["ts", "tsx", "js", "jsx", "mts", "cts"]
BESIDE_SUFFIXES = ["ts", "tsx", "js", "jsx"]
#: Roles whose files don't become entry points by themselves.
EXCLUDED = ("fixture", "example", "template", "benchmark", "generated", "buildOutput")
_SCRIPT_LIKE = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".vue", ".svelte", ".astro", ".mdx")


def manifest_files(manifests: DataFrame) -> DataFrame:
    """Rows (root, file) that manifests name by main, module, types, typings, browser, bin and (at any depth) exports."""

    def read(text: str | None) -> object:
        try:
            return json.loads(text) if text and text[0] in "{[\"" else text
        except ValueError:
            return text

    def named(main: str | None, module: str | None, types: str | None, typings: str | None, browser: str | None, bin_: str | None, exports: str | None) -> set[str]:
        shim, tools = read(browser), read(bin_)
        found = [x for x in (main, module, types, typings) if x] + ([shim] if isinstance(shim, str) else [v for v in shim.values() if isinstance(v, str) and v.endswith(_SCRIPT_LIKE)] if isinstance(shim, dict) else [])
        found += [tools] if isinstance(tools, str) else [v for v in tools.values() if isinstance(v, str)] if isinstance(tools, dict) else []
        return {x for x in [*found, *leaves(read(exports))] if x}

    schema = pa.schema([("root", pa.string()), ("file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return in_batches(((root, f) for root, *parts in rows for f in sorted(named(*parts))), schema)

    return manifests.select("root", "main", "module", "types", "typings", "browser", "bin", "exports").repartition("root").mapInArrow(run, "root string, file string")


def below_root(root: Column, file: Column) -> Column:
    return normalised(F.concat_ws("/", root, file))


def with_sources(named: DataFrame, files: DataFrame) -> DataFrame:
    """``named`` (root, file, …) with the path of the file there is: itself, or the source of a file of build output (the first suffix that exists)."""
    body = F.regexp_replace("file", r"^\./", "")
    stem = F.regexp_replace(F.regexp_replace(body, rf"^{OUTPUT}/({FORMATS}/)?", ""), r"(\.d)?\.[^./]*$", "")
    output = body.rlike(rf"^{OUTPUT}/")
    # A few manifests may name most of the files: what they name is dealt to all tasks before it is taken apart. An ending changes no folder, so a path is
    # made once for all its endings; the mark keeps a name that is empty or dots.
    before = lambda base: F.when(output, F.rtrim(below_root(F.col("root"), F.concat(base, F.lit(".\0"))), F.lit("\0")))
    based = dealt(named, *named.columns).withColumns({"__own": below_root(F.col("root"), F.col("file")), "__src": before(F.concat(F.lit("src/"), stem)), "__beside": before(stem)})
    ends = [F.concat("__src", F.lit(s)) for s in SOURCE_SUFFIXES] + [F.concat("__beside", F.lit(s)) for s in BESIDE_SUFFIXES]
    tried = based.select(*named.columns, F.posexplode(F.array("__own", *ends)).alias("__k", "path")).where("path is not null")
    there = tried.join(shuffled(files.select(F.col("rel_path").alias("path")).distinct()), "path")
    return there.groupBy(*named.columns).agg(F.min_by("path", "__k").alias("path"))


def detected(files: DataFrame, manifests: DataFrame, scripts: DataFrame, *, include: list[str] = (), include_tests: bool = False, include_stories: bool = False, frameworks: DataFrame | None = None) -> DataFrame:
    """Rows (path, kind, profile) of all entry points; the first detector that names a path tells its kind.

    files: rel_path. manifests: root and their fields. scripts: root, path (from the root), profile. frameworks: path, kind, profile. Those of roles that aren't code of their own, and tests
    and stories unless asked for, are left out; what the configuration includes or a framework brings always stays.
    """
    mine = files.select("rel_path")
    explicit = mine.where(F.col("rel_path").rlike(any_glob(list(include)))).select(F.col("rel_path").alias("path"), F.lit("explicit-config").alias("kind"), F.lit("both").alias("profile"))
    named = with_sources(manifest_files(manifests), files).select("path", F.lit("package-main").alias("kind"), F.lit("production").alias("profile"))
    run = with_sources(scripts.select("root", F.col("path").alias("file"), "profile"), files).select("path", F.lit("package-script").alias("kind"), "profile")
    names = manifests.select("root", F.explode(F.array(*map(F.lit, CONVENTIONS))).alias("file"))
    usual = names.select(below_root(F.col("root"), F.col("file")).alias("path")).join(shuffled(mine.toDF("path")), "path", "left_semi").select("path", F.lit("convention").alias("kind"), F.lit("production").alias("profile"))
    role = file_role(F.col("path"))
    barred = [*EXCLUDED, *([] if include_tests else ["test"]), *([] if include_stories else ["story"])]
    found = merged_entries([explicit, named, run, usual, *([frameworks] if frameworks is not None else [])])
    return found.where(F.col("kind").isin("explicit-config", "framework-pack") | ~role.isin(*barred))


def entry_graph(entries: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, label) of entry points, and edges (src, dst, kind) package → entry point → file. inventory: rel_path, workspace."""
    rows = entries.join(inventory.select(F.col("rel_path").alias("path"), F.coalesce("workspace", F.lit("")).alias("workspace")), "path")
    node = F.concat(F.lit("entry:"), "path")
    nodes = rows.select(node.alias("node"), F.lit("entrypoint").alias("kind"), F.concat_ws(" ", F.col("kind"), "profile").alias("label"))
    one = rows.select(F.concat(F.lit("package:"), "workspace").alias("src"), node.alias("dst"), F.lit("PackageToEntrypoint").alias("kind"))
    return nodes, one.unionByName(rows.select(node.alias("src"), F.col("path").alias("dst"), F.lit("EntrypointToFile").alias("kind")))
