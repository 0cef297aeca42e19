"""Queries of scripts' commands and of packages that need no import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import commands, exemptions
from graphloom.plans.queries import query
from graphloom.sources.projections import Canon

# Each file's script: its command (@p is the file, @k its package, ~ a single quote), whether the file is run, and the programs and modules named.
_COMMANDS = [
    ("node --watch -r ts-node/register ./@p", True, ["node", "ts-node/register"]),
    ('NODE_ENV=test tsx watch "@p" > log', True, ["tsx", "watch"]),
    ("npx --yes @k @p --bundle", True, ["npx", "@k"]),
    ("pnpm --filter web exec ts-node @p", True, ["pnpm", "ts-node", "@p"]),
    ("npm run @k -- @p", False, ["npm", "@k"]),
    ("node -e \"require(~@p~)\" x", False, ["node"]),
    ("concurrently \"tsc -w\" ~node --inspect @p~ --kill-others", True, ["concurrently", "tsc", "node"]),
    ("eslint . && node_modules/.bin/@k --config @p", True, ["eslint", "node_modules/.bin/@k", "@k"]),
    ("cross-env A=1 node --import=hook/esm @p", True, ["cross-env", "node", "hook/esm"]),
    ("yarn -w web @k @p", False, ["yarn", "@k"]),
    ("cd out; bun run @p | cat", True, ["cd", "bun", "@p", "cat"]),
    ("echo $HOME/@p", False, ["echo"]),
    ('sh -c "npx ~@k~ ; node ~@p~" || exit 1', True, ["sh", "npx", "@k", "node", "exit"]),
]
_SCRIPTS = {"build:all": "production", "dev": "development", "test:unit": "development", "postinstall": "both", "start": "production"}
_NAMED = "concat('src/', package, '/f', file_id, '.ts')"


def _filled(text: str) -> str:
    return f"replace(replace(replace('{text}', '~', chr(39)), '@p', {_NAMED}), '@k', package)"


def _by_turn(values: list[str]) -> str:
    return f"CASE file_id % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_SCRIPT = _by_turn([f"'{n}'" for n in _SCRIPTS])


@query(f"""s AS (SELECT file_id, {_SCRIPT} AS script, {_by_turn([f"'{p}'" for p in _SCRIPTS.values()])} AS profile, {_by_turn([str(run).lower() for _, run, _ in _COMMANDS])} AS run, {_NAMED} AS path,
      {_by_turn(["[" + ", ".join(_filled(w) for w in words) + "]" for _, _, words in _COMMANDS])} AS words FROM files)
    SELECT file_id, script, 'file' AS kind, path AS word, profile FROM s WHERE run UNION ALL SELECT DISTINCT file_id, script, 'package', unnest(words), NULL FROM s""", ("files",))  # fmt: skip
def script_commands(c: Canon) -> DataFrame:
    """The files that scripts run, and the programs and modules that they name: one script a file, thirteen ways to run it."""
    scripts = c.spark.sql(f"SELECT file_id, file_id AS root, {_SCRIPT} AS script, {_by_turn([_filled(t) for t, _, _ in _COMMANDS])} AS command FROM {{files}}", files=c["files"])
    read = commands.simple_commands(scripts)
    files = commands.command_files(read).select(F.col("root").alias("file_id"), "script", F.lit("file").alias("kind"), F.col("path").alias("word"), "profile")
    words = read.select(F.col("root").alias("file_id"), "script", F.lit("package").alias("kind"), F.explode(F.concat("programs", "modules")).alias("word"), F.lit(None).cast("string").alias("profile"))
    return files.unionByName(words.distinct())


# Packages by the brand's number: tools, plugins, packages that need others, and others.
_NAMES = ["react", "react-dom", "left-pad", "eslint-plugin-x", "vue", "nuxt", "css-loader", "typescript", "svelte", "lodash", "@types/node", "isbot", "@tanstack/vue-router"]
_PACKAGE = "CASE CAST(regexp_extract(dep, '([0-9]+)$', 1) AS INT) % 13 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMES)) + " END"
_DECLARED = f"SELECT workspace, {_PACKAGE} AS dep, CASE WHEN dep LIKE '%5' THEN 'optional dependency' ELSE dep_kind END AS dep_kind FROM"


@query(f"""d AS ({_DECLARED} declared), t AS (SELECT DISTINCT workspace, dep FROM d WHERE dep IN ('typescript') OR starts_with(dep, 'eslint-plugin-') OR starts_with(dep, '@types/') OR ends_with(dep, '-loader')),
    n(dep, need) AS (VALUES ('react', 'react-dom'), ('react-dom', 'react'), ('vue', 'nuxt'), ('vue', '@tanstack/vue-router'), ('isbot', '@tanstack/vue-router'), ('svelte', '@sveltejs/kit'))
    SELECT workspace, dep, 'tool' AS reason FROM t UNION ALL
    SELECT d.workspace, d.dep, concat('needed by ', min(o.dep)) FROM d JOIN n ON n.dep = d.dep JOIN d o ON o.workspace = d.workspace AND o.dep = n.need AND o.dep_kind <> 'optional dependency' GROUP BY d.workspace, d.dep""", ("declared",))  # fmt: skip
def exempt_dependencies(c: Canon) -> DataFrame:
    """Declared packages that no import has to use, and why."""
    rows = c.spark.sql(_DECLARED + " {declared}", declared=c["declared"])
    return exemptions.exempt(rows.withColumnRenamed("workspace", "root")).withColumnRenamed("root", "workspace")
