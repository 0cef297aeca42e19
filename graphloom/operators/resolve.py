"""Resolution of specifiers: candidate targets from several strategies, of which the first wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import dependency_name, unresolved_reason
from graphloom.functions.globs import glob_regex
from graphloom.operators.manifests import looked_up, manifest_maps, subpath
from graphloom.operators.paths import canonical_paths
from graphloom.operators.tables import shuffled

# What is tried after a path, in order.
SUFFIXES = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro", ".mdx", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


# The endings of TypeScript sources that stand behind an imported JavaScript ending, tried before it.
SOURCES_OF = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}


def probes(base: Column) -> Column:
    """The paths that are tried for one, in order."""
    stem = F.regexp_replace(base, r"\.[mc]?jsx?$", "")
    swapped = F.array().cast("array<string>")
    for ending, others in SOURCES_OF.items():
        swapped = F.when(base.endswith(ending), F.array(*[F.concat(stem, F.lit(o)) for o in others])).otherwise(swapped)
    return F.concat(swapped, F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(base, s)))


def probed_by(path: Column) -> Column:
    """The bases of which ``probes`` has a path, each once."""
    cut = lambda s: F.left(path, F.length(path) - F.lit(len(s)))
    bases = [F.when(path.endswith(s), cut(s)) for s in SUFFIXES]
    bases += [F.when(path.endswith(o), F.concat(cut(o), F.lit(ending))) for ending, others in SOURCES_OF.items() for o in others]
    return F.array_distinct(F.array_compact(F.array(*bases)))


def normalised(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    step = lambda done, p: F.when((p == ".") | (p == ""), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved(specifiers: DataFrame, files: DataFrame, *, aliases: list[tuple[str, str]] = (), externals: list[str] = ()) -> DataFrame:
    """``specifiers`` (src, specifier) with (dst_file, dst_dep, outcome, reason). files: rel_path.

    Externals come first, then aliases (longest prefix first), then relative paths; each candidate path is tried with every suffix. Bare ones
    that nothing finds are dependencies.
    """
    spec = F.col("specifier")
    rows = specifiers.select("src", "specifier").distinct()
    external = F.col("specifier").isin(*externals) if externals else F.lit(False)
    candidates: list[Column] = []
    for prefix, target in sorted(aliases, key=lambda a: -len(a[0])):
        candidates.append(F.when((spec == prefix) | spec.startswith(prefix + "/"), F.concat(F.lit(target), F.substring(spec, len(prefix) + 1, 1 << 20))))
    candidates.append(F.when(spec.startswith("."), F.concat_ws("/", F.regexp_replace("src", r"/?[^/]*$", ""), spec)))
    tried = F.array_compact(F.array(*candidates))
    paths = rows.where(~external).select("src", "specifier", F.posexplode(tried).alias("strategy", "base"))
    paths = paths.select("src", "specifier", "strategy", F.posexplode(probes(normalised(F.col("base")))).alias("probe", "path"))
    hits = paths.join(files.select(F.col("rel_path").alias("path")).distinct(), "path")
    best = hits.groupBy(F.col("src").alias("__s"), F.col("specifier").alias("__p")).agg(F.min_by("path", F.struct("strategy", "probe")).alias("dst_file"))
    out = rows.join(best, (F.col("src") == F.col("__s")) & (F.col("specifier") == F.col("__p")), "left").drop("__s", "__p")
    bare = ~spec.rlike(r"^[./#]")
    outcome = F.when(F.col("dst_file").isNotNull(), "ResolvedToFile").when(external | bare, "ResolvedToDependency").otherwise("Unresolved")
    return out.withColumn("outcome", outcome).withColumn("dst_dep", F.when(F.col("outcome") == "ResolvedToDependency", dependency_name(spec))).withColumn("reason", F.when(F.col("outcome") == "Unresolved", unresolved_reason(spec)))


# Where aliases come from, in order of precedence.
ORIGINS = ["Manifest", "SubpathImports", "BrowserField", "TsconfigPaths", "Vite", "Webpack", "Babel", "FrameworkGenerated"]


def cascade(specifiers: DataFrame, files: DataFrame, manifests: DataFrame, aliases: DataFrame, *, externals: list[str] = (), ignored: list[str] = (), links: DataFrame | None = None) -> DataFrame:
    """``specifiers`` (src, specifier, root) with (dst_file, dst_dep, origin, outcome, reason).

    root is the folder of the source's workspace. files: rel_path. manifests: root, name, main, exports, imports, browser. aliases: prefix, target, scope, origin.
    Every strategy makes candidate paths by equi joins, each is tried with every suffix, and the first that exists wins: aliases by origin, then by length, the
    ``#`` imports of the own manifest, paths relative to the source, the browser map, and packages of the repository (only through ``exports``
    where they have any). What none finds and is bare is a dependency, unless it is of a package whose ``exports`` lacks it. links: path, target of
    symbolic links: a candidate is also tried where its path leads through them, after the path as it stands.
    """
    spec, rank = F.col("specifier"), F.create_map(*[x for i, o in enumerate(ORIGINS) for x in (F.lit(o), F.lit(i))])
    rows = specifiers.select("src", "specifier", "root").distinct()
    off = (F.coalesce(dependency_name(spec).isin(*externals), F.lit(False)) if externals else F.lit(False)) | (spec.rlike("|".join(glob_regex(g) for g in ignored)) if ignored else F.lit(False))
    open_rows = rows.where(~off)
    parts = F.split(spec, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    met = open_rows.select("*", F.explode(heads).alias("prefix")).join(aliases, "prefix").where("scope is null or scope = '' or src like concat(scope, '/%')")
    own = lambda order, base, origin: F.struct(order.cast("int").alias("order"), base.alias("base"), origin.alias("origin"))
    by_alias = met.select("src", "specifier", own(1000 * (F.coalesce(rank[F.col("origin")], F.lit(9)) - 10) - F.least(F.length("prefix"), F.lit(999)), F.concat("target", F.substring(spec, F.length("prefix") + 1, 1 << 20)), F.col("origin")).alias("c"))
    maps = manifest_maps(manifests.select(F.col("root").alias("workspace"), F.col("name").alias("package"), "exports", "imports", "browser"))
    requests = open_rows.select("src", "specifier", F.col("root").alias("workspace"))
    under = lambda root, path: F.concat_ws("/", F.when(root != "", root), path)
    subpaths = looked_up(requests.where("specifier like '#%'"), maps, "imports").where("target is not null").select("src", "specifier", own(F.lit(10), under(F.col("workspace"), F.col("target")), F.lit("SubpathImports")).alias("c"))
    shims = looked_up(requests, maps, "browser").where("target is not null").select("src", "specifier", own(F.lit(30), under(F.col("workspace"), F.col("target")), F.lit("BrowserField")).alias("c"))
    near = open_rows.where("specifier like '.%'").select("src", "specifier", own(F.lit(20), F.concat_ws("/", F.regexp_replace("src", r"/?[^/]*$", ""), spec), F.lit(None).cast("string")).alias("c"))
    packages = manifests.where("name is not null").select(F.col("name").alias("dep"), F.col("root").alias("workspace"), "main", F.col("exports").isNotNull().alias("closed"))
    asked = open_rows.withColumn("dep", dependency_name(spec)).join(packages, "dep").select("src", F.col("specifier").alias("asked"), "workspace", "main", "closed", subpath(spec, F.col("dep")).alias("specifier"))
    shown = looked_up(asked, maps, "exports")
    plain = F.when(F.col("specifier") == ".", F.coalesce("main", F.lit(""))).otherwise(F.col("specifier"))
    inside = shown.select("src", F.col("asked").alias("specifier"), own(F.lit(40), under(F.col("workspace"), F.when(F.col("closed"), F.col("target")).otherwise(plain)), F.lit("Manifest")).alias("c"), (F.col("closed") & ~F.col("defined")).alias("miss"))
    tried = reduce(DataFrame.unionByName, [by_alias, subpaths, near, shims, inside.where("not miss").drop("miss")]).where("c.base is not null")
    bases = tried.select("src", "specifier", "c.order", "c.origin", normalised(F.col("c.base")).alias("base"), F.lit(0).alias("led"))
    if links is not None:
        led = canonical_paths(bases.select(F.col("base").alias("path")), links).where("outcome = 'linked'")
        bases = bases.unionByName(bases.join(shuffled(led), F.col("base") == F.col("path")).select("src", "specifier", "order", "origin", F.col("canonical").alias("base"), F.lit(1).alias("led")))
    tried_paths = files.select(F.col("rel_path").alias("tried"), F.col("rel_path").alias("path"), F.lit(0).alias("through")).distinct()
    if links is not None:  # what is tried may itself be a link to a file
        ends = canonical_paths(links.select("path"), links).where("outcome = 'linked'").select(F.col("path").alias("tried"), F.col("canonical").alias("path"), F.lit(1).alias("through"))
        tried_paths = tried_paths.unionByName(ends.join(shuffled(files.select(F.col("rel_path").alias("path")).distinct()), "path", "left_semi").select("tried", "path", "through"))
    # Files meet what they may stand for, some texts each, so that a base stays one row for all its probes.
    named = tried_paths.select("tried", "path", "through", F.explode(probed_by(F.col("tried"))).alias("base"))
    met_bases = bases.join(shuffled(named), "base").withColumn("probe", F.array_position(probes(F.col("base")), F.col("tried")))
    hits = met_bases.select("src", "specifier", "order", "origin", F.greatest("led", "through").alias("led"), "probe", "path")
    best = hits.groupBy(F.col("src").alias("__s"), F.col("specifier").alias("__p")).agg(F.min_by(F.struct("path", "origin"), F.struct("order", "led", "probe", "path")).alias("__hit"))
    missed = inside.where("miss").select(F.col("src").alias("__ms"), F.col("specifier").alias("__mp")).distinct()
    out = rows.join(shuffled(best), (F.col("src") == F.col("__s")) & (spec == F.col("__p")), "left").join(shuffled(missed), (F.col("src") == F.col("__ms")) & (spec == F.col("__mp")), "left")
    file = F.col("__hit.path")
    outcome = F.when(off, "Externalized").when(file.isNotNull(), "ResolvedToFile").when(F.col("__ms").isNull() & ~spec.rlike(r"^[./#]"), "ResolvedToDependency").otherwise("Unresolved")
    reason = F.when(outcome == "Externalized", "externalized").when(outcome != "Unresolved", None).when(F.col("__ms").isNotNull(), "workspace-exports-miss").otherwise(unresolved_reason(spec))
    dep = F.when(outcome == "ResolvedToDependency", dependency_name(spec))
    return out.select("src", "specifier", "root", file.alias("dst_file"), dep.alias("dst_dep"), F.col("__hit.origin").alias("origin"), outcome.alias("outcome"), reason.alias("reason"))


def expanded_globs(patterns: DataFrame, files: DataFrame, globs: list[str], *, cap: int = 500) -> DataFrame:
    """Edges (src, glob, path) from patterns (src, glob) to files that the glob fits, less those that one of the source's ``!`` globs fits.

    The distinct globs are known on the driver, so files are tested in one pass. ``cap`` edges per source and glob, in order of paths, is the operator's own limit.
    """
    tests = F.array_compact(F.array(*[F.when(F.col("rel_path").rlike(glob_regex(g.removeprefix("!"))), F.lit(g)) for g in sorted(set(globs))]))
    fits = files.select(F.col("rel_path").alias("path"), F.explode(tests).alias("glob"))
    all_edges = patterns.select("src", "glob").distinct().join(fits, "glob")
    barred = all_edges.where("glob like '!%'").select(F.col("src").alias("__s"), F.col("path").alias("__p")).distinct()
    edges = all_edges.where("glob not like '!%'").join(barred, (F.col("src") == F.col("__s")) & (F.col("path") == F.col("__p")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("src", "glob").orderBy("path"))
    return edges.withColumn("__k", rank).where(F.col("__k") <= cap).select("src", "glob", "path")


def merged_entries(seeds: list[DataFrame]) -> DataFrame:
    """Seeds (path, kind, profile) of several detectors in order; the first detector's kind wins for a path."""
    rows = reduce(DataFrame.unionByName, [s.select("path", "kind", "profile").withColumn("__order", F.lit(i)) for i, s in enumerate(seeds)])
    return rows.groupBy("path").agg(F.min_by("kind", F.struct("__order", "kind", "profile")).alias("kind"), F.min_by("profile", F.struct("__order", "kind", "profile")).alias("profile"))
