"""A scan: from a repository's files to its graph and findings, as one plan over rows (rel_path, text)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import DEVELOPMENT, NOT_DEAD, dead_code_candidate, percent, source_kind
from graphloom.functions.globs import any_glob
from graphloom.operators import adapters, analyzers, chains, commands, entrypoints, exemptions, frameworks, graph, liveness, paths, report, resolve, rules
from graphloom.operators.tables import Rounds, shuffled
from graphloom.sources import config, repo
from graphloom.sources.extract import extracted
from graphloom.sources.members import member_facts

# The kind of edge that a fact makes (others are their own kind), and facts that use a module as a whole.
EDGE_KINDS = {"side-effect": "SideEffectImport"}
WHOLE = ["DynamicImport", "Require", "ImportEquals", "ImportMetaGlob", "RequireContext"]
# Reasons for which a specifier can't be resolved at all, and folders whose sources import what isn't there.
BENIGN = ["unsupported-specifier", "externalized"]
MADE_UP = "__fixtures__|__mocks__|/__fixture__/|/fixtures/|/snapshots/|/test-files/"
# Packages that come with the runtime.
BUILT_IN = """assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net node
    os path perf_hooks process punycode querystring readline repl stream string_decoder sys test timers tls trace_events tty url util v8 vm wasi worker_threads zlib""".split()


@dataclass
class Scan:
    """Tables of one scan. What several steps need is written when it is first asked for."""

    rows: DataFrame
    include: tuple[str, ...] = ()
    workspace_globs: tuple[str, ...] | None = None
    production: bool = False
    profile: str = "both"
    include_entry_exports: bool = False
    exports_used_in_file: bool = True
    forbidden: tuple[rules.Forbidden, ...] = ()
    teams: tuple[tuple[str, str], ...] = ()
    team_packages: tuple[tuple[str, str], ...] = ()
    #: (glob over paths, tag) and (package, tag), for rules.
    tags: tuple[tuple[str, str], ...] = ()
    package_tags: tuple[tuple[str, str], ...] = ()
    externals: tuple[str, ...] = ()
    packs: tuple[frameworks.Pack, ...] = frameworks.PACKS
    toggles: dict[str, str] = field(default_factory=dict)
    #: Most files that one glob or context of a source means, in order of paths; without it all that fit.
    glob_cap: int | None = None
    #: Symbolic links (path, target) that imports may pass, see ``repo.symlinks``.
    symlinks: DataFrame | None = None

    @cached_property
    def rounds(self) -> Rounds:
        return Rounds(self.rows.sparkSession)

    @property
    def active(self) -> str:
        return "production" if self.production else self.profile

    @cached_property
    def workspaces(self) -> DataFrame:
        """The root and what the workspace globs name: those given, or those that the repository itself has."""
        globs = config.declared_globs(self.rows) if self.workspace_globs is None else list(self.workspace_globs)
        return self.rounds.table(config.discovered(repo.manifests(self.rows), globs))

    @cached_property
    def manifests(self) -> DataFrame:
        """Manifests of workspaces; those of fixtures and the like are none."""
        return self.rounds.table(repo.manifests(self.rows).join(self.workspaces.select("root"), "root", "left_semi"))

    @cached_property
    def files(self) -> DataFrame:
        """(rel_path, source_kind, role, workspace, root, directory) of the sources."""
        own = repo.inventory(self.rows.select("rel_path"), self.workspaces).where("source_kind is not null")
        roots = self.workspaces.select(F.col("workspace").alias("__w"), "root")
        return self.rounds.table(own.join(roots, F.col("workspace") == F.col("__w"), "left").drop("__w").withColumns({"root": F.coalesce("root", F.lit("")), "directory": config.folder(F.col("rel_path"))}))

    @cached_property
    def sources(self) -> DataFrame:
        """Rows (rel_path, text) of ``files``: a source is told by its name."""
        return self.rows.where(source_kind(F.col("rel_path")).isNotNull()).select("rel_path", "text")

    @cached_property
    def facts(self) -> DataFrame:
        return self.rounds.table(extracted(self.sources).withColumnRenamed("rel_path", "src"))

    @cached_property
    def members(self) -> DataFrame:
        return self.rounds.table(member_facts(self.sources))

    @cached_property
    def aliases(self) -> DataFrame:
        """(prefix, target, scope, origin) of the compiler's paths and of tools' configurations."""
        return self.rounds.table(config.tsconfig_aliases(self.rows, self.workspaces).unionByName(adapters.tool_aliases(self.config_inputs)))

    @cached_property
    def specifiers(self) -> DataFrame:
        """Distinct (src, specifier), whatever kind of fact names them; globs and folders are none."""
        return self.facts.where(F.col("specifier").isNotNull() & ~F.col("kind").isin("ImportMetaGlob", "RequireContext")).select("src", "specifier").distinct()

    @cached_property
    def resolutions(self) -> DataFrame:
        asked = self.specifiers.join(shuffled(self.files.select(F.col("rel_path").alias("src"), "root")), "src")
        return self.rounds.table(resolve.cascade(asked, self.files, self.manifests, self.aliases, externals=list(self.externals), links=self.symlinks))

    @cached_property
    def expanded(self) -> DataFrame:
        """(src, specifier, dst_file, kind) of globs and of ``require.context``; a negated glob of the same source takes files out."""
        globs = config.glob_rows(self.facts.where("kind = 'ImportMetaGlob'").select("src", F.col("specifier").alias("glob")))
        met = config.begun(globs.withColumn("deep", F.lit(True)), self.files, F.col("path")).where(F.expr("path rlike regex"))
        barred = met.where("negated").select("src", "path").distinct()
        found = met.where("not negated").join(shuffled(barred), ["src", "path"], "left_anti").select("src", F.col("glob").alias("specifier"), F.col("path").alias("dst_file"), F.lit("ImportMetaGlob").alias("kind"))
        asked = self.facts.where("kind = 'RequireContext'").select("src", "specifier", F.coalesce("name", F.lit(r"^\./.*$")).alias("regex"), (F.coalesce("local", F.lit("true")) != "false").alias("deep"))
        base = resolve.normalised(F.concat_ws("/", config.folder(F.col("src")), "specifier"))
        rest = F.concat(F.lit("."), F.expr("if(base = '', concat('/', path), substring(path, length(base) + 1))"))
        inside = config.begun(config.headed(asked.withColumn("base", base)), self.files, rest).where(F.expr("subject rlike regex")).select("src", "specifier", F.col("path").alias("dst_file"), F.lit("RequireContext").alias("kind"))
        kept = found.unionByName(inside).where("src <> dst_file").distinct()
        if self.glob_cap is None:
            return kept
        place = F.row_number().over(Window.partitionBy("src", "specifier", "kind").orderBy("dst_file"))
        return kept.withColumn("__k", place).where(F.col("__k") <= self.glob_cap).select("src", "specifier", "dst_file", "kind")

    @cached_property
    def links(self) -> DataFrame:
        """Facts with what their specifiers resolve to."""
        plain = self.facts.join(shuffled(self.resolutions.drop("root")), ["src", "specifier"])
        wide = self.expanded.select("src", "specifier", "kind", F.lit("*").alias("name"), F.lit(None).cast("string").alias("local"), F.lit(False).alias("is_type"), F.lit(None).cast("int").alias("line"), "dst_file", F.lit(None).cast("string").alias("dst_dep"), F.lit(None).cast("string").alias("origin"), F.lit("ResolvedToFile").alias("outcome"), F.lit(None).cast("string").alias("reason"))
        return self.rounds.table(plain.select(*wide.columns).unionByName(wide))

    @cached_property
    def edges(self) -> DataFrame:
        """(src, dst, kind): between files, and from files to external packages (``ext:`` and the name)."""
        kind = F.col("kind")
        shown = F.when(kind == "import", F.when(F.col("is_type"), "StaticImportType").otherwise("StaticImportValue")).when(kind == "reexport", F.when(F.col("name") == "*", "ReExportAll").otherwise("ReExportNamed"))
        for fact, label in EDGE_KINDS.items():
            shown = shown.when(kind == fact, label)
        dst = F.coalesce("dst_file", F.concat(F.lit("ext:"), "dst_dep"))
        return self.rounds.table(self.links.select("src", dst.alias("dst"), shown.otherwise(kind).alias("kind")).where("dst is not null").distinct())

    @cached_property
    def file_edges(self) -> DataFrame:
        return self.edges.where("dst not like 'ext:%'")

    @cached_property
    def commands(self) -> DataFrame:
        """(root, script, command, programs, modules, arguments) of the simple commands of manifests' scripts."""
        return self.rounds.table(commands.simple_commands(self.manifests.select("root", F.explode("scripts").alias("script", "command"))))

    @cached_property
    def entries(self) -> DataFrame:
        named = commands.command_files(self.commands)
        brought = frameworks.framework_entries(self.frameworks, self.files, packs=self.packs).select("path", "kind", "profile")
        tools = self.config_inputs.where("kind in ('entry', 'setup')").select("root", F.regexp_replace("value", "^<rootDir>/", "").alias("file"), F.when(F.col("kind") == "entry", "production").otherwise("development").alias("profile"))
        brought = brought.unionByName(entrypoints.with_sources(tools.distinct(), self.files).select("path", F.lit("framework-pack").alias("kind"), "profile"))
        return self.rounds.table(entrypoints.detected(self.files, self.manifests, named, include=list(self.include), frameworks=brought))

    @cached_property
    def config_inputs(self) -> DataFrame:
        """(root, rel_path, tool, kind, key, value) of what configuration files of tools name."""
        return self.rounds.table(adapters.config_inputs(self.rows))

    @cached_property
    def frameworks(self) -> DataFrame:
        """(root, framework, confidence, by_dependency, by_config) of the frameworks found."""
        own = repo.inventory(self.rows.select("rel_path"), self.workspaces).select("rel_path", F.col("workspace").alias("__w"))
        every = own.join(self.workspaces.select(F.col("workspace").alias("__w"), "root"), "__w", "left").withColumn("root", F.coalesce("root", F.lit("")))  # configurations in JSON too
        return self.rounds.table(frameworks.detections(every, self.manifests, packs=self.packs, toggles=self.toggles))

    @cached_property
    def seeds(self) -> DataFrame:
        rows = self.entries if self.active == "both" else self.entries.where(F.col("profile").isin(self.active, "both"))
        return rows.select(F.col("path").alias("node")).distinct()

    @cached_property
    def reached_as(self) -> DataFrame:
        """(node, entry_kinds, profiles): from entry points of which kinds and profiles a file is reached, in the active profile; one fixpoint for all."""
        rows = self.entries.join(shuffled(self.seeds), F.col("path") == F.col("node"), "left_semi")
        found = graph.reach_sets(self.file_edges, rows.select(F.struct("kind", "profile").alias("label"), F.col("path").alias("node")))
        each = F.when(F.col("label.profile") == "both", F.array(F.lit("production"), F.lit("development"))).otherwise(F.array("label.profile"))
        known = found.select("node", "label.kind", F.explode(each).alias("profile")).groupBy("node").agg(F.collect_set("kind").alias("entry_kinds"), F.collect_set("profile").alias("profiles"))
        return self.rounds.table(known)

    @cached_property
    def reached(self) -> DataFrame:
        return self.reached_as.select("node")

    @cached_property
    def nodes(self) -> DataFrame:
        """(node, kind, label) of workspaces, packages, files, entry points and external packages."""
        spaces = self.workspaces.select(F.concat(F.lit("workspace:"), "root").alias("node"), F.lit("workspace").alias("kind"), F.col("workspace").alias("label"))
        packages = self.workspaces.select(F.concat(F.lit("package:"), "workspace").alias("node"), F.lit("package").alias("kind"), F.col("workspace").alias("label"))
        files = self.files.select(F.col("rel_path").alias("node"), F.lit("file").alias("kind"), F.col("rel_path").alias("label"))
        external = self.edges.where("dst like 'ext:%'").select(F.col("dst").alias("node"), F.lit("external").alias("kind"), F.substring("dst", 5, 1 << 20).alias("label")).distinct()
        return reduce(DataFrame.unionByName, [spaces, packages, files, entrypoints.entry_graph(self.entries, self.files)[0], external])

    @cached_property
    def wanted(self) -> DataFrame:
        whole = self.links.where(F.col("kind").isin(*WHOLE) & F.col("dst_file").isNotNull()).select(F.col("src").alias("importer"), F.col("dst_file").alias("source"), F.lit("*").alias("name"), F.lit(False).alias("is_type"))
        typed = self.links.where("kind = 'JsDocImport' and dst_file is not null").select(F.col("src").alias("importer"), F.col("dst_file").alias("source"), F.lit("*").alias("name"), F.lit(True).alias("is_type"))
        named = self.links.where("kind = 'import' and dst_file is not null").select(F.col("src").alias("importer"), F.col("dst_file").alias("source"), "name", "is_type")
        passed = self.links.where("kind = 'reexport' and dst_file is not null").select(F.col("src").alias("reexporter"), F.col("dst_file").alias("source"), F.col("name").alias("original"), F.col("local").alias("exported"), (F.col("name") == "*").alias("is_star"), "is_type")
        reads = self.members.where("kind in ('read', 'write')").select(F.col("rel_path").alias("__i"), F.col("parent").alias("alias"), "member")
        through = self.links.where("kind = 'import' and dst_file is not null").select(F.col("src").alias("__i"), F.col("local").alias("alias"), F.col("dst_file").alias("file"), F.col("name").alias("exported"))
        spaces = reads.join(shuffled(through), ["__i", "alias"]).select("file", F.col("exported").alias("alias"), "member").distinct()
        return liveness.demand(reduce(DataFrame.unionByName, [named, whole, typed]), passed, self.reached.withColumnRenamed("node", "file"), None if self.include_entry_exports else self.seeds.withColumnRenamed("node", "file"), spaces)

    @cached_property
    def origins(self) -> DataFrame:
        """(file, name, origin, original, hops, cyclic) of names that files pass on, from another module at once or as an import that they export."""
        there = self.links.where("dst_file is not null")
        passed = there.where("kind = 'reexport'").select(F.col("src").alias("reexporter"), F.col("dst_file").alias("source"), F.col("name").alias("original"), F.col("local").alias("exported"))
        shown = self.facts.where("kind = 'export' and local is not null").select(F.col("src").alias("reexporter"), F.col("name").alias("exported"), "local")
        taken = there.where("kind = 'import'").select(F.col("src").alias("reexporter"), F.col("dst_file").alias("source"), F.col("name").alias("original"), "local")
        return self.rounds.table(chains.export_origins(passed.unionByName(taken.join(shown, ["reexporter", "local"]).select(*passed.columns))))

    def find(self, *names: str) -> DataFrame:
        """(query, rel_path): the file that each name means, by its path or the end of it."""
        return paths.suffix_lookup(self.rows.sparkSession.createDataFrame([(n,) for n in names], "query string"), self.files)

    @cached_property
    def pressure(self) -> DataFrame:
        """(file_id, unresolved, resolved) specifiers of each file; those that can't be resolved by their nature don't count."""
        lost = (F.col("outcome") == "Unresolved") & ~F.coalesce(F.col("reason").isin(*BENIGN), F.lit(False))
        return self.rounds.table(self.resolutions.groupBy(F.col("src").alias("file_id")).agg(F.count_if(lost).alias("unresolved"), F.count_if(F.col("outcome").startswith("Resolved")).alias("resolved")))

    @cached_property
    def declared(self) -> DataFrame:
        return repo.declared(self.manifests)

    @cached_property
    def used(self) -> DataFrame:
        """(root, dep, production, development): what reached sources, configurations, style sheets and script commands use, and for which profile.

        A file of a role that isn't code counts as development use whether it is reached or not; docs and test fixtures count for nothing. Packages behind a
        configured alias are no packages.
        """
        files = self.files.where(~F.col("rel_path").startswith("docs/") & ~F.col("rel_path").rlike(MADE_UP)).select(F.col("rel_path").alias("src"), "root", "role")
        near = self.reached_as.select(F.col("node").alias("__n"), "profiles")
        apart = F.col("role").isin(*NOT_DEAD)
        as_ = lambda p: F.coalesce(F.array_contains("profiles", p), F.lit(False))
        asked = self.links.where("dst_dep is not null and origin is null").select("src", F.col("dst_dep").alias("dep")).distinct()
        code = asked.join(shuffled(files), "src").join(shuffled(near), F.col("src") == F.col("__n"), "left")
        code = code.select("root", "dep", (~apart & as_("production") & ~F.col("role").isin(*DEVELOPMENT)).alias("production"), (apart | as_("development")).alias("development"))
        home = repo.inventory(self.rows.select("rel_path"), self.workspaces).select("rel_path", "workspace").join(self.workspaces, "workspace").select("rel_path", "root")
        of = lambda rows, production, development: rows.select("root", "dep", F.lit(production).alias("production"), F.lit(development).alias("development"))
        styles = of(config.style_packages(self.rows).join(shuffled(home), "rel_path"), True, False)
        run = of(commands.command_packages(self.commands, self.declared), True, True)
        tools = of(adapters.packages(self.config_inputs), False, True)
        rows = reduce(DataFrame.unionByName, [code, styles, of(config.extended_packages(self.rows), False, True), run, tools])
        return self.rounds.table(rows.groupBy("root", "dep").agg(F.bool_or("production").alias("production"), F.bool_or("development").alias("development")))

    @cached_property
    def globbed(self) -> DataFrame:
        """(file) of the targets of expanded globs and contexts: that they live is a guess."""
        return self.expanded.select(F.col("dst_file").alias("file")).distinct()

    @cached_property
    def total_pct(self) -> DataFrame:
        """One row: the share of specifiers that stay unresolved."""
        total = self.pressure.agg(F.coalesce(F.sum("unresolved"), F.lit(0)).alias("u"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("r"))
        return total.select(percent(F.col("u"), F.col("u") + F.col("r")).alias("pct"))

    def unused_files(self) -> DataFrame:
        files = self.files.withColumn("file_id", F.col("rel_path"))
        return analyzers.unused_files(files, self.reached, self.file_edges, self.pressure, production=self.active == "production")

    def unused_exports(self) -> DataFrame:
        exports = self.facts.where("kind = 'export' and name is not null").select(F.col("src").alias("file"), "name", "is_type").distinct()
        there = exports.join(shuffled(self.reached.withColumnRenamed("node", "file")), "file", "left_semi")
        live = liveness.live_exports(there, self.wanted).select("file", "name")
        if self.exports_used_in_file:
            live = live.unionByName(self.members.where("kind = 'use'").select(F.col("rel_path").alias("file"), F.col("member").alias("name"))).distinct()
        files = self.files.where(dead_code_candidate(F.col("role"), F.col("rel_path"), production=self.active == "production")).select(F.col("rel_path").alias("file"))
        dead = there.join(shuffled(live), ["file", "name"], "left_anti").join(shuffled(files), "file", "left_semi")
        code = F.when(F.col("is_type"), "unused-type").otherwise("unused-export")
        own = self.pressure.where("unresolved > 0").select(F.col("file_id").alias("file"), "unresolved")
        both = self.file_edges.where("src <> dst").select(F.col("src").alias("file"), F.col("dst").alias("near")).unionByName(self.file_edges.where("src <> dst").select(F.col("dst").alias("file"), F.col("src").alias("near"))).distinct()
        near = both.join(shuffled(own.toDF("near", "unresolved")), "near").groupBy("file").agg(F.sum("unresolved").alias("neighbour"))
        asked = self.wanted.select("file").distinct().withColumn("wanted", F.lit(True))
        rows = dead.join(shuffled(own), "file", "left").join(shuffled(near), "file", "left").join(shuffled(asked), "file", "left").join(shuffled(self.globbed.withColumn("globbed", F.lit(True))), "file", "left").crossJoin(F.broadcast(self.total_pct))  # one row
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        no = lambda c: F.coalesce(F.col(c), F.lit(False))
        sure = analyzers.export_confidence(F.col("is_type"), zero("unresolved"), F.col("pct"), zero("neighbour"), no("globbed"), no("wanted"))
        return analyzers.findings(rows, code, F.concat_ws("#", "file", "name"), sure)

    def unused_members(self) -> DataFrame:
        own = self.members.where("kind = 'member' and not is_public and member_kind <> 'Setter'").select(F.col("rel_path").alias("file"), "parent", "member")
        through = self.links.where("kind = 'import' and dst_file is not null").select(F.col("src").alias("__i"), F.col("local").alias("alias"), F.col("dst_file").alias("file"), F.col("name").alias("parent"))
        refs = self.members.where("kind in ('read', 'write')").select(F.col("rel_path").alias("__i"), F.col("parent").alias("alias"), "member", F.col("kind").alias("access")).join(shuffled(through), ["__i", "alias"])
        dead = liveness.unused_members(own, refs.select("file", "parent", "member", "access"))
        dead = dead.join(shuffled(self.globbed.withColumn("globbed", F.lit(True))), "file", "left")
        return analyzers.findings(dead, "unused-member", F.concat(F.concat_ws("#", "file", "parent"), F.lit("."), "member"), F.when(F.col("globbed"), "low").otherwise("medium"))

    def dependencies(self) -> tuple[DataFrame, DataFrame]:
        """Findings of declared packages that nothing uses, and of used ones that the workspace doesn't declare."""
        declared, used = (x.withColumnRenamed("root", "workspace") for x in (self.declared, self.used))
        if self.active == "production":
            declared_now, used_now = declared.where("dep_kind <> 'dev dependency'"), used.where("production")
        else:
            declared_now, used_now = declared, used.where("production or development")
        names = self.manifests.where("name is not null").select(F.col("name").alias("dep")).distinct()
        free = exemptions.exempt(self.declared).withColumnRenamed("root", "workspace")
        unused = analyzers.unused_dependencies(declared_now.join(free, ["workspace", "dep"], "left_anti"), used_now, names)
        home = self.files.select(F.col("rel_path").alias("file_id"), F.col("root").alias("workspace"))
        lost = self.pressure.join(shuffled(home), "file_id").groupBy("workspace").agg(F.sum("unresolved").alias("unresolved"))
        scripts = self.entries.join(shuffled(home), F.col("path") == F.col("file_id")).groupBy("workspace").agg(F.bool_and(F.col("kind") == "package-script").alias("only_scripts"))
        unused = unused.join(lost, "workspace", "left").join(scripts, "workspace", "left")
        sure = analyzers.dependency_confidence(F.coalesce("unresolved", F.lit(0)), F.coalesce("only_scripts", F.lit(False)), F.col("dep_kind"))
        heads = self.aliases.select(F.col("prefix").alias("dep")).distinct()
        missing = analyzers.unlisted_dependencies(declared, used.where("production or development")).where(~F.col("dep").isin(*BUILT_IN)).join(names, "dep", "left_anti").join(heads, "dep", "left_anti")
        at = F.concat_ws(":", F.when(F.col("workspace") != "", F.col("workspace")), "dep")
        return analyzers.findings(unused, "unused-dependency", at, sure).distinct(), analyzers.findings(missing, "unlisted-dependency", at, "medium")

    def cycles(self) -> DataFrame:
        """One finding a component, type imports included: its shortest cycle through the least file, of low confidence if a generated file is in it; the
        evidence has the edges where it could be broken."""
        chains = graph.cycle_chains(self.file_edges, graph.strong_components(self.file_edges)).where("length > 2")
        sure = F.when(F.exists("chain", lambda f: f.contains(".gen.") | f.contains(".generated.") | f.contains(".gen/")), "low").otherwise("high")
        shown = F.array_join("chain", " -> ")
        edges = report.break_edges(chains).groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "src", "dst"))), lambda e: F.concat(e["src"], F.lit(" -> "), e["dst"])).alias("edges"))  # a chain's
        return analyzers.findings(chains.join(shuffled(edges), "component"), "cycle", shown, sure, evidence=F.col("edges"))

    @cached_property
    def contexts(self) -> DataFrame:
        """(node, path, workspace, package, tags, profiles, entry_kinds) of files, as rules see them."""
        near = self.reached_as.select(F.col("node").alias("__n"), "entry_kinds", F.when(F.size("profiles") > 0, F.concat("profiles", F.array(F.lit("all")))).otherwise(F.col("profiles")).alias("profiles"))
        base = self.files.select(F.col("rel_path").alias("node"), F.col("rel_path").alias("path"), "workspace", F.col("workspace").alias("package")).join(near, F.col("node") == F.col("__n"), "left").drop("__n")
        given = [F.when(F.col("path").rlike(any_glob([g])), F.lit(t)) for g, t in self.tags] + [F.when(F.col("package") == p, F.lit(t)) for p, t in self.package_tags]
        kinds = F.transform(F.coalesce("entry_kinds", F.array().cast("array<string>")), lambda k: F.concat(F.lit("entrypoint-kind:"), k))
        own = F.array_distinct(F.array_compact(F.array(*given))) if given else F.array().cast("array<string>")
        return base.withColumn("tags", F.concat(own, kinds))

    def boundaries(self) -> DataFrame:
        found = rules.violations(self.file_edges, self.contexts, list(self.forbidden))
        return analyzers.findings(found, "boundary-violation", F.col("subject"), "high", rule=F.col("rule"), severity="error")

    def ownership(self) -> DataFrame:
        """Files that nobody owns, edges between owners, and files that two or more other owners import; nothing without teams and owners' rules."""
        owners = [(pattern, " ".join(names)) for pattern, names in config.owner_rules(self.rows)]
        if not (owners or self.teams or self.team_packages):
            return analyzers.findings(self.files.limit(0), "ownership-unowned", F.col("rel_path"), "high")
        named = self.files.withColumns({"file_id": F.col("rel_path"), "package": F.col("workspace")})
        files = analyzers.owned(named, list(self.teams), owners, list(self.team_packages))
        judged = ~F.col("role").isin(*NOT_DEAD) & ~F.col("rel_path").startswith("docs/")
        unowned = analyzers.findings(files.where(judged & F.col("owner").isNull()), "ownership-unowned", F.col("rel_path"), "high")
        from_judged = self.file_edges.join(files.where(judged).select(F.col("rel_path").alias("src")), "src", "left_semi")
        crossing = self.rounds.table(analyzers.cross_owner(from_judged, files))
        edges = analyzers.findings(crossing.select("src", "dst").distinct(), "ownership-cross-owner", F.concat_ws(" -> ", "src", "dst"), "high")
        shared = analyzers.findings(analyzers.owner_hotspots(crossing), "ownership-hotspot", F.col("dst"), "high", severity="info")
        return unowned.unionByName(edges).unionByName(shared)

    def unused_packages(self) -> DataFrame:
        """Workspaces with code or entry points of which no file is reached."""
        files = self.files.where("workspace is not null").withColumns({"file_id": F.col("rel_path"), "package": F.col("workspace")})
        candidate = ~F.col("role").isin(*NOT_DEAD) & ~F.col("rel_path").startswith("docs/")
        if self.active == "production":
            candidate &= ~F.col("role").isin(*DEVELOPMENT)
        entered = files.join(shuffled(self.seeds), F.col("rel_path") == F.col("node"), "left_semi")
        dead = analyzers.unused_packages(files.where(candidate).unionByName(entered).distinct(), self.reached.join(shuffled(files.where(candidate).select(F.col("rel_path").alias("node"))), "node", "left_semi"))
        return analyzers.findings(dead, "unused-package", F.col("package"), "medium")

    def duplicate_exports(self) -> DataFrame:
        passed = self.links.where("kind = 'reexport' and dst_file is not null").select(F.col("src").alias("reexporter"), F.col("dst_file").alias("source"), F.col("name").alias("original"), F.col("local").alias("exported"), (F.col("name") == "*").alias("is_star"))
        found = analyzers.duplicate_exports(passed)
        shown = F.transform("paths", lambda p: F.concat(p["reexporter"], F.lit(" exports it as "), p["exported"]))
        return analyzers.findings(found.where("original <> '*'"), "duplicate-export", F.col("source"), "medium", evidence=F.concat(F.array("original"), shown))

    @cached_property
    def findings(self) -> DataFrame:
        """(id, code, severity, confidence, subject, rule_name, evidence, remedy, category, workspace) of all analyzers."""
        parts = [self.unused_files(), self.unused_exports(), self.unused_members(), *self.dependencies(), self.unused_packages(), self.duplicate_exports(), self.cycles(), self.ownership()]
        if self.forbidden:
            parts.append(self.boundaries())
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        kind = F.substring_index("code", "-", 1)
        category = F.col("code")
        for first, name in analyzers.CATEGORIES.items():
            category = F.when(kind == first, F.lit(name)).otherwise(category)
        home = self.files.select(F.col("rel_path").alias("__path"), "workspace")
        first = report.subject_path(F.substring_index("subject", " -> ", 1))
        return self.rounds.table(analyzers.with_remedy(rows).distinct().withColumn("category", category).join(shuffled(home), first == F.col("__path"), "left").drop("__path"))

    def in_context(self) -> DataFrame:
        """The findings with the frameworks of their workspaces."""
        first = report.subject_path(F.substring_index("subject", " -> ", 1))
        return frameworks.with_context(self.findings, self.frameworks, self.files, first)

    def inventories(self) -> tuple[DataFrame, DataFrame]:
        """Files (rel_path, role, workspace) and workspaces (workspace, root, files), both sorted."""
        files = self.files.select("rel_path", "role", "workspace").orderBy("rel_path")
        counted = self.files.groupBy("workspace").agg(F.count("*").alias("files"))
        return files, self.workspaces.join(counted, "workspace", "left").select("workspace", "root", F.coalesce("files", F.lit(0)).alias("files")).orderBy("workspace")

    def debug_resolve(self, specifier: str, source: str) -> str:
        """How one specifier of one source resolves, in words."""
        row = self.resolutions.where((F.col("specifier") == specifier) & (F.col("src") == source)).first()
        if row is None:
            return f"{source} has no specifier {specifier}"
        return f"{specifier} from {source}: {row['outcome']} {row['dst_file'] or row['dst_dep'] or row['reason']}" + (f" by {row['origin']}" if row["origin"] else "")

    def summary(self) -> DataFrame:
        """Counts of findings beside files, edges and how many specifiers stay unresolved."""
        total = self.pressure.agg(F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved"))
        total = total.withColumn("pressure", percent(F.col("unresolved"), F.col("unresolved") + F.col("resolved")))
        sizes = self.files.agg(F.count("*").alias("files")).crossJoin(self.edges.agg(F.count("*").alias("edges")))
        return report.counts(self.findings).crossJoin(total).crossJoin(sizes)  # one row each

    def explain(self, name: str) -> tuple[DataFrame, DataFrame]:
        """For a finding's id or subject, or a file (by its path or the end of it): the shortest path from an entry point to its file, and the findings of that file."""
        named = self.findings.where((F.col("id") == name) | (F.col("subject") == name) | F.col("subject").startswith(name + "#"))
        meant = self.rounds.table(named.select(report.subject_path(F.col("subject")).alias("node")).distinct())
        if meant.isEmpty():
            meant = self.find(name).where("rel_path is not null").select(F.col("rel_path").alias("node"))
        else:
            meant = meant.unionByName(self.files.where(F.col("rel_path") == name).select(F.col("rel_path").alias("node"))).distinct()
        proof = graph.shortest_proofs(self.file_edges, self.seeds).join(meant, "node", "left_semi")
        related = self.findings.join(meant, report.subject_path(F.col("subject")) == F.col("node"), "left_semi")
        return proof, related

    def dot(self) -> DataFrame:
        """Lines of a DOT graph; files with findings are marked."""
        parts = self.findings.select(F.explode(F.split("subject", " -> ")).alias("part"))
        hit = parts.select(report.subject_path(F.col("part")).alias("node")).distinct().withColumn("hit", F.lit(", color=red"))
        quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
        nodes = self.nodes.join(hit, "node", "left").select(F.concat(F.lit("  "), quote(F.col("node")), F.lit(" [label="), quote(F.col("label")), F.coalesce("hit", F.lit("")), F.lit("];")).alias("value"))
        package, into = entrypoints.entry_graph(self.entries, self.files)
        edges = self.edges.unionByName(into).select(F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" [label="), quote(F.col("kind")), F.lit("];")).alias("value"))
        ends = self.rows.sparkSession.createDataFrame([(0, "digraph repository {"), (2, "}")], "part int, value string")
        return nodes.unionByName(edges).select(F.lit(1).alias("part"), "value").unionByName(ends).orderBy("part", "value").select("value")

    def write(self, path: str, form: str = "json") -> None:
        """Findings as JSON lines or text lines, or the graph as DOT lines, in a folder."""
        if form == "json":
            self.findings.write.json(path)
        elif form == "text":
            self.findings.select(F.concat_ws(" ", "severity", "code", "confidence", "subject").alias("value")).write.text(path)
        elif form == "dot":
            self.dot().coalesce(1).write.text(path)
        else:
            raise ValueError(f"unknown form {form}")

    def exit_code(self) -> int:
        """1 if a finding is an error or, being sure, would block a review."""
        return int(not report.reviewed(self.findings).where("severity = 'error' or decision = 'blocking'").isEmpty())
