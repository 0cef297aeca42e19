"""Tags that structure, dependencies and folders suggest, the rules that assign them, and fences around packages that only tests reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.governance import TAG

# Dependencies that show a framework, in order, with its tag.
FRAMEWORKS = [
    ("react", "framework-react"), ("react-dom", "framework-react"), ("next", "framework-next"), ("vue", "framework-vue"), ("nuxt", "framework-nuxt"),
    ("@angular/core", "framework-angular"), ("svelte", "framework-svelte"), ("@sveltejs/kit", "framework-sveltekit"), ("solid-js", "framework-solid"),
    ("@remix-run/react", "framework-remix"), ("astro", "framework-astro"), ("express", "framework-express"), ("fastify", "framework-fastify"),
    ("@nestjs/core", "framework-nest"), ("hono", "framework-hono"), ("@trpc/server", "framework-trpc"), ("graphql", "framework-graphql"),
    ("@apollo/server", "framework-apollo"), ("prisma", "framework-prisma"), ("drizzle-orm", "framework-drizzle"), ("tailwindcss", "framework-tailwind"),
    ("@storybook/react", "framework-storybook"), ("@storybook/vue3", "framework-storybook"), ("vitest", "framework-vitest"), ("jest", "framework-jest"),
    ("playwright", "framework-playwright"), ("cypress", "framework-cypress"), ("electron", "framework-electron"), ("react-native", "framework-react-native"),
    ("expo", "framework-expo"),
]
# Folders (in any case) that have a role. ``store`` stands for two patterns, so its files count twice.
ROLE_FOLDERS = {name: 1 for name in ("pages", "app", "api", "components", "hooks", "utils", "lib", "services", "models", "types", "middleware", "config", "constants", "helpers")} | {"store": 2}
# Kinds of entries that are tests.
TEST_KINDS = ["test", "vitest", "jest", "storybook", "story"]


def structure_tags(files: DataFrame, teams: DataFrame | None = None, *, least: int = TAG) -> DataFrame:
    """(name, glob, source, files) of workspaces and packages of several files, and of teams (team, paths, tags) without tags (files null)."""
    count = lambda col, source, mark, odd: (
        files.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("glob")).agg(F.count("*").alias("files")).where(F.col("files") >= least)
        .select(F.concat(F.lit(mark), F.regexp_replace("glob", odd, "-")).alias("name"), "glob", F.lit(source).alias("source"), "files")
    )
    out = count("workspace", "workspace", "ws-", r"[/\\@]").unionByName(count("package", "package", "pkg-", r"[/\\@.]"))
    if teams is None:
        return out
    bare = teams.where(F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0)
    glob = F.coalesce(F.get("paths", F.lit(0)), F.concat(F.lit("<"), F.col("team"), F.lit("-paths>")))
    return out.unionByName(bare.select(F.concat(F.lit("team-"), F.col("team")).alias("name"), glob.alias("glob"), F.lit("ownership").alias("source"), F.lit(None).cast("long").alias("files")))


def framework_tags(declared: DataFrame) -> DataFrame:
    """(name, dep) of frameworks whose dependency (any kind but optional) some workspace declares; the first signature in order stands for a tag."""
    known = F.create_map(*[F.lit(x) for i, (dep, tag) in enumerate(FRAMEWORKS) for x in (dep, f"{i:02d}{tag}")])
    hits = declared.where("dep_kind <> 'optional dependency'").select("dep", F.try_element_at(known, F.col("dep")).alias("__t")).where("__t is not null")
    return hits.groupBy(F.substring("__t", 3, 99).alias("name")).agg(F.min_by("dep", "__t").alias("dep"))


def role_tags(files: DataFrame, *, least: int = TAG) -> DataFrame:
    """(name, glob, source, files) of folder roles that several files have; a file counts once for a role, whatever the number of such folders."""
    weight = F.create_map(*[F.lit(x) for pair in ROLE_FOLDERS.items() for x in pair])
    parts = F.array_distinct(F.transform(F.split("rel_path", "/"), F.lower))
    roles = files.select(F.explode(F.array_intersect(parts, F.array(*map(F.lit, ROLE_FOLDERS)))).alias("role"))
    out = roles.groupBy("role").agg(F.count("*").alias("__n")).select("role", (F.col("__n") * F.try_element_at(weight, F.col("role"))).cast("long").alias("files")).where(F.col("files") >= least)
    return out.select(F.concat(F.lit("role-"), F.col("role")).alias("name"), F.concat(F.lit("**/"), F.col("role"), F.lit("/**")).alias("glob"), F.lit("file-pattern").alias("source"), "files")


def tag_assignments(tags: DataFrame) -> DataFrame:
    """Tags (name, glob, source) with the override (JSON) that assigns each; those of frameworks and of all files have none."""
    some = tags.where("source <> 'framework-detection' and glob <> '**/*'")
    by_workspace = F.to_json(F.struct(F.array("glob").alias("workspaces"), F.array("name").alias("tags")))
    by_files = F.to_json(F.struct(F.array("glob").alias("files"), F.array("name").alias("tags")))
    return some.select("name", F.when(F.col("source") == "workspace", by_workspace).otherwise(by_files).alias("override"))


def fences(entries: DataFrame, files: DataFrame, *, kinds: list[str] = TEST_KINDS) -> DataFrame:
    """(package, kinds) of packages in whose workspaces every entry (workspace, kind) is of ``kinds``. Entries and packages meet as sets."""
    by_workspace = entries.groupBy(F.col("workspace").alias("__w")).agg(F.collect_set("kind").alias("__k"))
    packages = files.where("package is not null").select("workspace", "package").distinct()
    found = packages.join(by_workspace, F.col("workspace").eqNullSafe(F.col("__w"))).groupBy("package").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__k")))).alias("kinds"))
    return found.where((F.size("kinds") > 0) & F.forall("kinds", lambda k: k.isin(*kinds)))
