"""Scalar functions and classifications as column expressions (all in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What folders, file names and extensions mean.
SOURCE_KINDS = [
    (r"\.d\.[mc]?ts$", "dts"), (r"\.ts$", "ts"), (r"\.tsx$", "tsx"), (r"\.mts$", "mts"), (r"\.cts$", "cts"), (r"\.js$", "js"), (r"\.jsx$", "jsx"),
    (r"\.mjs$", "mjs"), (r"\.cjs$", "cjs"), (r"\.vue$", "vue"), (r"\.svelte$", "svelte"), (r"\.astro$", "astro"), (r"\.mdx$", "mdx"),
]
ROLES = [
    (r"/(generated|__generated__)/|\.(generated|gen)\.[tj]sx?$", "generated"),
    (r"/(dist|build|coverage|storybook-static)/|(^|/)\.(next|nuxt|output|svelte-kit|mastra|turbo|vercel|astro|angular|cache)/", "buildOutput"),
    (r"(^|/)fixtures/|/(test-fixtures|snapshots|test-files)/|\.snapshot\.[tj]sx?$", "fixture"),
    (r"(^|/)examples/", "example"), (r"(^|/)templates/", "template"), (r"(^|/)benchmarks/", "benchmark"),
    (r"/(__tests__|__mocks__)/|^tests?/|(^|/)e2e/|\.(test|spec|test-utils)\.[^/]*$", "test"),
    (r"\.(stories|story)\.[^/]*$|/\.storybook/|^stories/", "story"),
    (r"(^|/)(package|tsconfig|tsconfig\.base)\.json$|\.config\.[^/]*$", "config"),
]
NOT_DEAD = ("fixture", "example", "template", "benchmark", "config", "generated", "buildOutput")
DEVELOPMENT = ("test", "story")
ASSETS = r"\.(css|scss|sass|less|styl|svg|png|jpe?g|gif|ico|webp|avif|woff2?|ttf|eot|html|md|txt|wasm|graphql|gql)$"
PACKAGE_NAME = r"^(@[a-z0-9][^/:!?]*/[^/:!?]+|[a-z0-9][^/:!?]*)$"


def first_match(value: Column, table: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first expression in ``table`` that ``value`` matches; the order counts."""
    out = F.when(value.rlike(table[0][0]), F.lit(table[0][1]))
    for pattern, label in table[1:]:
        out = out.when(value.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default))


def source_kind(path: Column) -> Column:
    return first_match(path, SOURCE_KINDS, None)


def file_role(path: Column) -> Column:
    return first_match(path, ROLES, "source")


def dead_code_candidate(role: Column, path: Column, *, production: bool = False) -> Column:
    """Whether a file can be reported: not of an excluded role, no ambient declaration, no docs; in production no test or story."""
    ok = ~role.isin(*NOT_DEAD) & ~path.rlike(SOURCE_KINDS[0][0]) & ~path.startswith("docs/")
    return ok & ~role.isin(*DEVELOPMENT) if production else ok


def dependency_name(specifier: Column) -> Column:
    """``@a/b/c`` is ``@a/b``, ``x/y`` is ``x``; relative and absolute ones have none."""
    found = F.regexp_extract(specifier, r"^(@[^/]*/[^/]*|[^./@][^/]*)", 1)
    return F.when(specifier.isNull() | (found == ""), F.lit(None).cast("string")).otherwise(found)


def looks_like_package(name: Column) -> Column:
    return name.rlike(PACKAGE_NAME) & ~name.rlike(ASSETS) & ~name.rlike(r"\.([cm]?[tj]s|[tj]sx|module|json|mdx)$") & (name != "src")


def unresolved_reason(specifier: Column) -> Column:
    """Why a specifier that nothing resolves is unresolved."""
    return (
        F.when(specifier.rlike(r"^(node|bun|deno):"), F.lit("externalized"))
        .when(specifier.rlike(r"^(virtual:|~)|\$\{|[*?]|" + ASSETS), F.lit("unsupported-specifier"))
        .when(specifier.startswith("#"), F.lit("exports-condition-miss"))
        .otherwise(F.lit("missing-file"))
    )


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2"))


def directory(path: Column, parts: int = 2) -> Column:
    """The first folders of a path, null if it has fewer (the file's name is no folder)."""
    split = F.split(path, "/")
    return F.when(F.size(split) > parts, F.array_join(F.slice(split, 1, parts), "/"))


def subject_path(subject: Column) -> Column:
    """A finding's subject as a path: without ``#name``, ``./`` and slashes before it."""
    return F.regexp_replace(F.trim(F.substring_index(subject, "#", 1)), r"^(\./)?/*", "")


def finding_id(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of a digest of code, subject, rule and first evidence."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def percent(part: Column, whole: Column) -> Column:
    """Whole hundredths, rounded down; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(F.lit(0)).cast("long")


def lowered(confidence: Column) -> Column:
    return F.when(confidence == "high", F.lit("medium")).otherwise(F.lit("low"))
