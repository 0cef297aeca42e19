"""Manifest maps (``exports``, ``imports``, ``browser``) as rows, and lookups in them.

A manifest's JSON is read once, in Arrow batches, into rows (workspace, field, pattern, target, rank). A lookup joins requests with one array of
entries per workspace, so that a request stays one row however many patterns its workspace has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conditions in order of preference; without any of them the first key in order that leads to a target counts.
CONDITIONS = ["types", "import", "require", "node", "default"]
ENTRY = "field string, pattern string, target string, rank int"


def target_of(value: object) -> str | None:
    """The target of a string, a condition map or a list of alternatives."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        preferred = [c for c in CONDITIONS if c in value][:1]
        options = [value[k] for k in preferred or sorted(value)]
    else:
        options = value if isinstance(value, list) else []
    return next((t for t in map(target_of, options) if t is not None), None)


def leaves(value: object) -> Iterator[str]:
    """Every string under a value, whatever the condition."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, (dict, list)):
        for part in value.values() if isinstance(value, dict) else value:
            yield from leaves(part)


def exports_entries(value: object) -> list[tuple[str, str | None]]:
    """(subpath, target) in the order that lookups try: exact ones, then wildcards.

    An exact subpath without a target bars those after it, except among alternatives; a wildcard without one is passed over.
    """
    if isinstance(value, list):
        return [e for part in value for e in exports_entries(part) if e[1] is not None]
    if not (isinstance(value, dict) and any(k.startswith(".") for k in value)):
        found = target_of(value)
        return [(".", found)] if found is not None else []
    exact = [(k, target_of(value[k])) for k in sorted(value) if not k.endswith("*")]
    return exact + [(k, t) for k in sorted(value) if k.endswith("*") and (t := target_of(value[k])) is not None]


def wildcard_leaves(value: object) -> Iterator[str]:
    """Targets with a star, under subpaths with a star."""
    if isinstance(value, list):
        for part in value:
            yield from wildcard_leaves(part)
    elif isinstance(value, dict):
        subpaths = any(k.startswith(".") for k in value)
        for key, part in value.items():
            if not subpaths:
                yield from wildcard_leaves(part)
            elif "*" in key:
                yield from (x for x in leaves(part) if "*" in x)


def entries(package: str | None, exports: str | None, imports: str | None, browser: str | None) -> list[tuple[str, str, str | None, int]]:
    """Rows of ``ENTRY``; text that is no JSON has none."""

    def read(text: str | None) -> object:
        try:
            return json.loads(text) if text else None
        except ValueError:
            return None

    ex, im, br = map(read, (exports, imports, browser))
    rows = [("exports", k, t, i) for i, (k, t) in enumerate(exports_entries(ex))]
    rows += [("exports-files", t, t, i) for i, t in enumerate(sorted(set(wildcard_leaves(ex))))]
    if isinstance(im, dict):
        rows += [("imports", k, target_of(im[k]), i) for i, k in enumerate(sorted(im, key=lambda k: (k.endswith("*"), k)))]
    if isinstance(br, str) and package:
        rows.append(("browser", package, br, 0))
    elif isinstance(br, dict):
        rows += [("browser", k, br[k], i) for i, k in enumerate(sorted(br)) if isinstance(br[k], str) and not k.endswith("*")]
    return rows


def manifest_maps(manifests: DataFrame) -> DataFrame:
    """Rows (workspace, field, pattern, target, rank) of manifests (workspace, package, exports, imports, browser), the last three as JSON texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["workspace", "field", "pattern", "target", "rank"]
        for batch in batches:
            rows = [(w, *e) for w, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in entries(*parts)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.int32()], strict=True)], names)

    return manifests.select("workspace", "package", "exports", "imports", "browser").mapInArrow(run, f"workspace string, {ENTRY}")


def _by_workspace(maps: DataFrame, field: str) -> DataFrame:
    rows = maps.where(F.col("field") == field)
    return rows.groupBy(F.col("workspace").alias("__w")).agg(F.array_sort(F.collect_list(F.struct("rank", "pattern", "target"))).alias("__entries"))


def looked_up(requests: DataFrame, maps: DataFrame, field: str) -> DataFrame:
    """``requests`` (workspace, specifier, …) with pattern, target and defined (the map has the specifier, even if without a target).

    The first entry in order of rank that equals the specifier, or whose part before a final star starts it, wins; each star of its target becomes the rest.
    """
    spec = F.col("specifier")
    stem = lambda e: F.regexp_replace(e["pattern"], r"\*$", "")
    fits = lambda e: (e["pattern"] == spec) | (e["pattern"].endswith("*") & spec.startswith(stem(e)))
    hit = F.get(F.filter("__entries", fits), F.lit(0))
    rows = requests.join(_by_workspace(maps, field), F.col("workspace") == F.col("__w"), "left").withColumn("__hit", hit)
    pattern, target = F.col("__hit.pattern"), F.col("__hit.target")
    rest = F.substring(spec, F.length(pattern), F.length(spec))
    out = F.when(pattern.endswith("*"), F.replace(target, F.lit("*"), rest)).otherwise(target)
    return rows.withColumns({"pattern": pattern, "target": F.regexp_replace(out, r"^\./", ""), "defined": pattern.isNotNull()}).drop("__w", "__entries", "__hit")


def wildcard_files(maps: DataFrame, files: DataFrame) -> DataFrame:
    """Files (workspace, path; paths from the workspace's root) that a wildcard of ``exports`` lays open: those that start and end like a target around its first star."""
    path = F.regexp_replace("path", r"^\./", "")
    target = lambda e: F.regexp_replace(e["target"], r"^\./", "")
    before, after = (lambda e: F.substring_index(target(e), "*", 1)), (lambda e: F.regexp_replace(target(e), r"^[^*]*\*", ""))
    rows = files.select("workspace", "path").distinct().join(_by_workspace(maps, "exports-files"), F.col("workspace") == F.col("__w"))
    return rows.where(F.exists("__entries", lambda e: path.startswith(before(e)) & path.endswith(after(e)))).select("workspace", "path")


def subpath(specifier: Column, package: Column) -> Column:
    """What a specifier of a package asks of its ``exports``: ``.`` or ``./rest``; null for other packages."""
    return F.when(specifier == package, ".").when(specifier.startswith(F.concat(package, F.lit("/"))), F.concat(F.lit("."), F.substring(specifier, F.length(package) + 1, F.length(specifier))))
