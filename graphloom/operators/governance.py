"""Governance mining: rules that the observed coupling suggests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import directory
from graphloom.operators.rules import IMPORT_KINDS

# Least counts.
BOUNDARY, MUTUAL, TAG, LAYER, HOTSPOT, HOTSPOTS, OWNER_HINT = 3, 2, 3, 3, 5, 20, 3


def package_coupling(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges between packages: (src_pkg, dst_pkg, total, type_only, dynamic, value, sources)."""
    a, b = (files.select(F.col("file_id").alias(f"__{s}"), F.col("package").alias(f"{s}_pkg")) for s in ("src", "dst"))
    rows = edges.where(F.col("kind").isin(*IMPORT_KINDS)).join(a, F.col("src") == F.col("__src")).join(b, F.col("dst") == F.col("__dst")).where("src_pkg <> dst_pkg")
    typed, dynamic = F.col("kind") == "StaticImportType", F.col("kind") == "DynamicImport"
    return rows.groupBy("src_pkg", "dst_pkg").agg(F.count("*").alias("total"), F.count_if(typed).alias("type_only"), F.count_if(dynamic).alias("dynamic"), F.count_if(~typed & ~dynamic).alias("value"), F.count_distinct("src").alias("sources"))


def forbidden_suggestions(coupling: DataFrame) -> DataFrame:
    level = F.when(F.col("total") >= 3 * BOUNDARY, "high").when(F.col("total") >= 2 * BOUNDARY, "medium").otherwise("low")
    return coupling.where(F.col("total") >= BOUNDARY).select("src_pkg", "dst_pkg", "total", level.alias("confidence"))


def mutual_coupling(coupling: DataFrame) -> DataFrame:
    there, back = coupling.select(F.col("src_pkg").alias("a"), F.col("dst_pkg").alias("b"), F.col("total").alias("there")), coupling.select(F.col("dst_pkg").alias("a"), F.col("src_pkg").alias("b"), F.col("total").alias("back"))
    both = there.where("a < b").join(back, ["a", "b"]).where((F.col("there") >= MUTUAL) & (F.col("back") >= MUTUAL))
    total = F.col("there") + F.col("back")
    return both.select("a", "b", "there", "back", F.when(total >= 12, "high").when(total >= 6, "medium").otherwise("low").alias("confidence"))


def directory_tags(files: DataFrame) -> DataFrame:
    return files.select(directory(F.col("rel_path")).alias("directory")).where("directory is not null").groupBy("directory").agg(F.count("*").alias("files")).where(F.col("files") >= TAG)


def layers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(top, leaves): workspaces that import and aren't imported, each with those that are imported and don't import, as one sorted list.

    None if fewer than ``LAYER`` workspaces import others. The list is of workspaces, which a repository names one by one.
    """
    a, b = (files.select(F.col("file_id").alias(f"__{s}"), F.col("workspace").alias(f"{s}_ws")) for s in ("src", "dst"))
    pairs = edges.join(a, F.col("src") == F.col("__src")).join(b, F.col("dst") == F.col("__dst")).where("src_ws <> dst_ws").select("src_ws", "dst_ws", "src").distinct()
    sources, targets = pairs.select(F.col("src_ws").alias("w")).distinct(), pairs.select(F.col("dst_ws").alias("w")).distinct()
    tops, leaves = sources.join(targets, "w", "left_anti").select(F.col("w").alias("top")), targets.join(sources, "w", "left_anti").select(F.col("w").alias("leaf"))
    enough = sources.agg(F.count("*").alias("__n")).where(F.col("__n") >= LAYER).drop("__n")
    listed = leaves.agg(F.array_sort(F.collect_list("leaf")).alias("leaves")).where(F.size("leaves") > 0)
    return tops.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(enough))  # one row each


def hotspots(edges: DataFrame, files: DataFrame, *, n: int = HOTSPOTS) -> DataFrame:
    """The files with most edges: (file_id, fan_in, fan_out, cross_package, rank). ``n`` is the report's length."""
    pkg = files.select(F.col("file_id").alias("__f"), F.col("package").alias("__p"))
    rows = edges.select("src", "dst").distinct().join(pkg.toDF("__a", "pa"), F.col("src") == F.col("__a")).join(pkg.toDF("__b", "pb"), F.col("dst") == F.col("__b"))
    ends = rows.select(F.explode(F.array(F.struct(F.col("dst").alias("file_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("file_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"), (F.col("pa") != F.col("pb")).cast("int").alias("x"))
    total = ends.groupBy("e.file_id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"), F.sum("x").alias("cross_package")).where(F.col("fan_in") + F.col("fan_out") >= HOTSPOT)
    first = total.orderBy((F.col("fan_in") + F.col("fan_out")).desc(), F.col("cross_package").desc(), "file_id").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy((F.col("fan_in") + F.col("fan_out")).desc(), F.col("cross_package").desc(), "file_id")))


def team_hotspots(edges: DataFrame, files: DataFrame, *, n: int = HOTSPOTS) -> DataFrame:
    """The files with most import edges, seen by their owners: (file_id, fan_in, fan_out, cross_package, cross_owner, teams, advice, rank). files: file_id, package, owner.

    An edge crosses owners where both ends have one and they differ; teams are the owners of a file and of its neighbours, sorted. ``advice`` tells what stands out first:
    ``share-ownership``, ``extract-package``, ``define-surface`` (fan-in), ``split`` (fan-out) or ``review``. ``n`` is the report's length.
    """
    known = files.select("file_id", "package", "owner")
    used = edges.where(F.col("kind").isin(*IMPORT_KINDS)).select("src", "dst", "kind").distinct()
    ends = F.array(*[F.struct(F.col(a).alias("file_id"), F.col(b).alias("near"), F.lit(i).alias("i")) for a, b, i in (("dst", "src", 1), ("src", "dst", 0))])
    sides = used.select(F.explode(ends).alias("e")).select("e.*")
    near = sides.join(known.toDF("near", "near_package", "near_owner"), "near").join(known, "file_id")
    apart = lambda a, b: F.count_if(F.col(a) != F.col(b))
    total = near.groupBy("file_id").agg(F.sum("i").alias("fan_in"), F.sum(1 - F.col("i")).alias("fan_out"), apart("package", "near_package").alias("cross_package"), apart("owner", "near_owner").alias("cross_owner"), F.count("*").alias("__all"))
    order = [F.col("__all").desc(), F.col("cross_owner").desc(), F.col("file_id")]
    first = total.where(F.col("__all") >= HOTSPOT).orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    teams = near.join(F.broadcast(first.select("file_id")), "file_id", "left_semi").groupBy("file_id").agg(F.collect_set("owner").alias("__o"), F.collect_set("near_owner").alias("__n"))  # ``n`` files
    advice = (
        F.when((F.col("cross_owner") > 0) & (F.col("cross_owner") > F.floor(F.col("__all") / 3)), "share-ownership").when(F.col("cross_package") > F.floor(F.col("__all") / 2), "extract-package")
        .when((F.col("fan_in") > 3 * F.col("fan_out")) & (F.col("fan_out") > 0), "define-surface").when((F.col("fan_out") > 3 * F.col("fan_in")) & (F.col("fan_in") > 0), "split").otherwise("review")
    )
    return first.join(teams, "file_id").select("file_id", "fan_in", "fan_out", "cross_package", "cross_owner", F.sort_array(F.array_union("__o", "__n")).alias("teams"), advice.alias("advice"), "rank")


# Kinds of governance actions with their effort and impact, in the order in which equal ones come.
ACTIONS = {
    "add-boundary-rule": ("low", "high"), "assign-ownership": ("medium", "high"), "introduce-tags": ("low", "medium"), "split-hotspot": ("high", "high"), "enforce-layering": ("low", "medium"),
    "add-reachability-fence": ("low", "medium"),
}
TAG_SOURCES = ("workspace", "package", "directory-cluster", "ownership", "framework-detection", "file-pattern")


def governance_actions(suggestions: DataFrame, hints: DataFrame, tags: DataFrame, hot: DataFrame, layered: DataFrame, fenced: DataFrame) -> DataFrame:
    """One row for each kind of action that the findings ask for: (priority, kind, effort, impact, items, detail); most impact first, then least effort.

    suggestions: confidence (only ``high`` ones count). hints: edges. tags: source. hot: file_id, fan_in, fan_out (those of three times the least count). layered, fenced: any rows.
    The rules themselves stay in the tables they come from.
    """
    severe = hot.select("file_id", (F.col("fan_in") + F.col("fan_out")).alias("edges")).where(F.col("edges") >= 3 * HOTSPOT)
    worst = severe.orderBy(F.col("edges").desc(), "file_id").limit(3).agg(F.array_sort(F.collect_list(F.struct((-F.col("edges")).alias("e"), "file_id"))).alias("w"))  # three files
    worst = worst.select(F.array_join(F.transform("w", lambda x: F.format_string("%s (%d edges)", x["file_id"].cast("string"), -x["e"])), ", ").alias("detail"))
    by_source = F.concat_ws(", ", *[F.when(F.count_if(F.col("source") == s) > 0, F.format_string(f"%d {s}", F.count_if(F.col("source") == s))) for s in TAG_SOURCES])
    count = lambda rows, detail: rows.agg(F.count("*").alias("items"), detail.alias("detail"))
    none: Column = F.max(F.lit(""))
    found = {
        "add-boundary-rule": count(suggestions.where("confidence = 'high'"), none), "assign-ownership": count(hints, F.format_string("%d edges between areas", F.sum("edges"))), "introduce-tags": count(tags, by_source),
        "split-hotspot": severe.agg(F.count("*").alias("items")).crossJoin(worst), "enforce-layering": count(layered, none), "add-reachability-fence": count(fenced, none),
    }  # one row each
    level = {"low": 1, "medium": 2, "high": 3}
    rows = [found[kind].select(F.lit(kind).alias("kind"), F.lit(effort).alias("effort"), F.lit(impact).alias("impact"), "items", "detail", F.lit(-level[impact]).alias("__i"), F.lit(level[effort]).alias("__e"), F.lit(k).alias("__k")) for k, (kind, (effort, impact)) in enumerate(ACTIONS.items())]
    there = reduce(DataFrame.unionByName, rows).where("items > 0")
    return there.select(F.row_number().over(Window.orderBy("__i", "__e", "__k")).alias("priority"), "kind", "effort", "impact", "items", "detail")  # six rows at most


def ownership_hints(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Top folders with several edges to other packages: (folder, edges)."""
    a = files.select(F.col("file_id").alias("__a"), F.col("package").alias("pa"), directory(F.col("rel_path"), 1).alias("folder"))
    b = files.select(F.col("file_id").alias("__b"), F.col("package").alias("pb"))
    rows = edges.join(a, F.col("src") == F.col("__a")).join(b, F.col("dst") == F.col("__b")).where("pa <> pb and folder is not null")
    return rows.groupBy("folder").agg(F.count("*").alias("edges")).where(F.col("edges") >= OWNER_HINT)


def unowned_directories(files: DataFrame, *, least: int = OWNER_HINT) -> DataFrame:
    """(directory, files) of the top folders that have so many files without an owner. files: rel_path, owner."""
    rows = files.where("owner is null").select(directory(F.col("rel_path"), 1).alias("directory")).where("directory is not null")
    return rows.groupBy("directory").agg(F.count("*").alias("files")).where(F.col("files") >= least)


def parity_scores(results: DataFrame) -> DataFrame:
    """Cases and passes overall, by family, by tool: (family, tool, level, cases, passed, score)."""
    agg = results.groupingSets([[], ["family"], ["tool"]], "family", "tool").agg(F.count("*").alias("cases"), F.count_if("ok").alias("passed"), F.grouping_id().alias("__g"))
    level = F.when(F.col("__g") == 3, "overall").when(F.col("__g") == 1, "family").otherwise("tool")
    return agg.select("family", "tool", level.alias("level"), "cases", "passed", F.round(100 * F.col("passed") / F.col("cases"), 4).alias("score"))
