"""Boundary rules: edges held against forbidden (from, to) filters.

Rules are few and come from the configuration, so each filter is compiled on the driver into a boolean expression over the two ends of an edge;
all rules are tested in one pass over the edges, without a join between edges and rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.globs import any_glob
from graphloom.operators.graph import reach_sets, reversed_edges
from graphloom.operators.tables import shuffled

# Labels of edge kinds.
KIND_LABELS = {
    "StaticImportValue": ["static", "static-value"], "StaticImportType": ["static", "static-type", "type"], "DynamicImport": ["dynamic"], "Require": ["require"],
    "SideEffectImport": ["side-effect"], "ReExportNamed": ["re-export", "re-export-named"], "ReExportAll": ["re-export", "re-export-all"], "RequireResolve": ["require-resolve"],
    "ImportMetaGlob": ["import-meta-glob"], "JsDocImport": ["jsdoc-import", "type"], "TripleSlashFile": ["triple-slash", "triple-slash-file"],
    "TripleSlashTypes": ["triple-slash", "triple-slash-types", "type"], "ImportMetaResolve": ["import-meta-resolve"], "RequireContext": ["require-context"],
    "UrlConstructor": ["url-constructor"], "ImportEquals": ["import-equals", "require"],
}
IMPORT_KINDS = ("StaticImportValue", "StaticImportType", "DynamicImport", "Require", "SideEffectImport", "ReExportNamed", "ReExportAll")


@dataclass(frozen=True)
class End:
    """All dimensions that are given must hold; a list holds if any of its globs or values does. Null fails the positive ones and passes the negative."""

    path: tuple[str, ...] = ()
    path_not: tuple[str, ...] = ()
    workspace: tuple[str, ...] = ()
    workspace_not: tuple[str, ...] = ()
    package: tuple[str, ...] = ()
    package_not: tuple[str, ...] = ()
    tag: tuple[str, ...] = ()
    tag_not: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    profiles: tuple[str, ...] = ()
    entry_kinds: tuple[str, ...] = ()
    reachable_from: tuple[str, ...] = ()
    reaches: tuple[str, ...] = ()

    def column(self, side: str, labels: Column) -> Column:
        """``side`` is the prefix of the end's columns: path, workspace, package, tags, profiles, entry_kinds, and flags per rule."""
        ok = F.lit(True)
        for name in ("path", "workspace", "package"):
            x = F.col(f"{side}_{name}")
            if yes := getattr(self, name):
                ok &= F.coalesce(x.rlike(any_glob(list(yes))), F.lit(False))
            if no := getattr(self, f"{name}_not"):
                ok &= ~F.coalesce(x.rlike(any_glob(list(no))), F.lit(False))
        for name, values in (("tags", self.tag), ("profiles", self.profiles), ("entry_kinds", self.entry_kinds)):
            if values:
                ok &= F.coalesce(F.arrays_overlap(F.col(f"{side}_{name}"), F.array(*map(F.lit, values))), F.lit(False))
        if self.tag_not:
            ok &= ~F.coalesce(F.arrays_overlap(F.col(f"{side}_tags"), F.array(*map(F.lit, self.tag_not))), F.lit(False))
        if self.kinds:
            ok &= F.arrays_overlap(labels, F.array(*map(F.lit, self.kinds)))
        return ok


@dataclass(frozen=True)
class Forbidden:
    name: str
    source: End = field(default_factory=End)
    target: End = field(default_factory=End)


def kind_labels(kind: Column, dependency: Column | None = None) -> Column:
    table = F.create_map(*[x for k, v in KIND_LABELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.coalesce(F.try_element_at(table, kind), F.array().cast("array<string>"))
    return found if dependency is None else F.when(dependency.isNotNull(), F.array_union(found, F.array(F.lit("external")))).otherwise(found)


def violations(edges: DataFrame, contexts: DataFrame, rules: list[Forbidden]) -> DataFrame:
    """Rows (rule, src, dst, subject) of edges (src, dst, kind) that a rule forbids. contexts: node, path, workspace, package, tags, profiles, entry_kinds.

    ``reachable_from`` and ``reaches`` are globs over paths; each rule that has one gets its seeds' closure, all in one labelled fixpoint.
    """
    fields = [c for c in ("path", "workspace", "package", "tags", "profiles", "entry_kinds") if c in contexts.columns]
    plain = edges.select("src", "dst", "kind").distinct()
    sides = {s: contexts.select(F.col("node").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in fields]) for s in ("from", "to")}
    rows = plain.join(shuffled(sides["from"]), F.col("src") == F.col("from_node")).join(shuffled(sides["to"]), F.col("dst") == F.col("to_node"))
    for direction, graph in (("reachable_from", edges), ("reaches", reversed_edges(edges))):
        wanted = [(f"{i}:{side}", globs) for i, r in enumerate(rules) for side, end in (("from", r.source), ("to", r.target)) if (globs := getattr(end, direction))]
        if not wanted:
            continue
        seeds = contexts.select(F.col("node"), F.explode(F.array_compact(F.array(*[F.when(F.col("path").rlike(any_glob(list(g))), F.lit(label)) for label, g in wanted]))).alias("label"))
        labelled = reach_sets(graph, seeds.select("label", "node")).groupBy("node").agg(F.collect_set("label").alias(direction))
        for side, key in (("from", "src"), ("to", "dst")):
            own = labelled.select(F.col("node").alias("__n"), F.col(direction).alias(f"{side}_{direction}"))
            rows = rows.join(shuffled(own), F.col(key) == F.col("__n"), "left").drop("__n")
    labels = kind_labels(F.col("kind"))
    tests = []
    for i, r in enumerate(rules):
        ok = r.source.column("from", labels) & r.target.column("to", labels)
        for side, end in (("from", r.source), ("to", r.target)):
            for direction in ("reachable_from", "reaches"):
                if getattr(end, direction):
                    ok &= F.coalesce(F.array_contains(F.col(f"{side}_{direction}"), f"{i}:{side}"), F.lit(False))
        tests.append(F.when(ok, F.lit(r.name)))
    hit = rows.withColumn("rule", F.explode(F.array_compact(F.array(*tests))))
    return hit.select("rule", "src", "dst", F.concat_ws(" -> ", "from_path", "to_path").alias("subject")).distinct()
