"""Commands of scripts against a table written by hand, and packages that need no import."""

from graphloom.operators import commands, exemptions

# Command; paths among its arguments; programs and modules of its simple commands.
TABLE = [
    ("node tools/dev.ts && echo done", {"tools/dev.ts"}, {"node", "echo"}),
    ("node -r ts-node/register/transpile-only --enable-source-maps ./src/main.ts --port 3", {"src/main.ts"}, {"node", "ts-node/register/transpile-only"}),
    ("node --require=@scope/hook/register --import ./setup.mjs a.mjs", {"a.mjs"}, {"node", "@scope/hook/register", "./setup.mjs"}),
    ("node -e \"require('./no.js'); go('src/no.ts')\" src/neither.ts; node yes.cjs", {"yes.cjs"}, {"node"}),
    ("node -p 1 no.js | cat yes.js", {"yes.js"}, {"node", "cat"}),
    ("tsx watch --clear-screen=false src/server.ts", {"src/server.ts"}, {"tsx", "watch"}),
    ("tsx -r dotenv/config src/x.tsx src/y.jsx", {"src/x.tsx", "src/y.jsx"}, {"tsx", "dotenv/config", "src/x.tsx"}),
    ("NODE_ENV=production node dist/main.js", {"dist/main.js"}, {"node"}),
    ("cross-env A=1 B='x y' ts-node scripts/seed.ts", {"scripts/seed.ts"}, {"cross-env", "ts-node", "scripts/seed.ts"}),
    ("npx --yes esbuild src/a.ts --outfile=dist/a.js", {"src/a.ts"}, {"npx", "esbuild"}),
    ("bunx vitest run lib/a", {"lib/a"}, {"bunx", "vitest"}),
    ("bun run src/b.ts", {"src/b.ts"}, {"bun", "src/b.ts"}), ("bun x knip tools/k.mts", {"tools/k.mts"}, {"bun", "knip"}), ("bun src/c.ts", {"src/c.ts"}, {"bun", "src/c.ts"}),
    ("pnpm --filter web exec tsx scripts/go.ts", {"scripts/go.ts"}, {"pnpm", "tsx", "scripts/go.ts"}),
    ("yarn -w vitest src/no.test.ts", set(), {"yarn", "src/no.test.ts"}), ("npm run build -- src/no.ts", set(), {"npm", "build"}), ("yarn dlx -q pkg scripts/q.js", {"scripts/q.js"}, {"yarn"}),
    ("concurrently \"tsc -w\" 'node --watch ./server.js' --names a,b tools/z.ts", {"server.js", "tools/z.ts"}, {"concurrently", "tsc", "node"}),
    ("sh -c \"concurrently 'node a.js' \\\"node b.js && tsx 'c.ts'\\\"\"", {"a.js", "b.js", "c.ts"}, {"sh", "concurrently", "node", "tsx", "c.ts"}),
    ("(cd app/web && ./node_modules/.bin/rollup -c rollup.config.js)", {"app/web", "node_modules/.bin/rollup", "rollup.config.js"}, {"cd", "./node_modules/.bin/rollup", "rollup"}),
    ("eslint src/**/*.ts $FILES.ts \"src/$X.ts\" .ts x.mjsx", {"src/**/*.ts"}, {"eslint"}),
    ("a\nnode 'b c.js' ''\\", {"c.js"}, {"a", "node", "b"}), ("echo 'open src/u.ts", {"src/u.ts"}, {"echo"}), ("", set(), set()), ("  && ;| ", set(), set()), (None, set(), set()),
]


def test_simple_commands(spark):
    rows = spark.createDataFrame([(str(k), "dev:x", c) for k, (c, _, _) in enumerate(TABLE)], "root string, script string, command string")
    read = commands.simple_commands(rows).cache()
    files = {(r["root"], r["path"]) for r in commands.command_files(read).collect()}
    used = {(r["root"], x) for r in read.collect() for x in [*r["programs"], *r["modules"]]}
    for k, (command, paths, words) in enumerate(TABLE):
        assert ({p for n, p in files if n == str(k)}, {w for n, w in used if n == str(k)}) == (paths, words), command
    assert commands.simple_commands(rows.limit(0)).count() == 0


def test_long_commands(spark):
    words = [f"src/f{k}.ts" for k in range(20000)]
    rows = spark.createDataFrame([("", "build", "eslint " + " ".join(words)), ("", "lint", "x" * 300_000 + " '" + "y " * 100_000 + "' src/z.ts")], "root string, script string, command string")
    got = {(r["script"], r["path"]) for r in commands.command_files(commands.simple_commands(rows)).collect()}
    assert got == {("build", w) for w in words} | {("lint", "src/z.ts")}


def test_profiles(spark):
    names = {"start": "production", "build:web": "production", "test": "development", "dev:x": "development", "pretest": "both", "release": "both", "bench": "development", "starter": "both"}
    rows = spark.createDataFrame([("", n, "node a.js") for n in names], "root string, script string, command string")
    assert {r["script"]: r["profile"] for r in commands.command_files(commands.simple_commands(rows)).collect()} == names


def test_command_packages(spark):
    said = [("a", "x", "webpack && npx -y @scope/tool && node -r @s/reg/esm -r esm x.js && yarn run mocha"), ("b", "x", "echo webpack tool; node -r ./esm.js x.js"), ("c", "x", "./node_modules/.bin/webpack")]
    declared = [(w, d, "dependency") for w in "abc" for d in ("webpack", "@scope/tool", "@other/tool", "@s/reg", "reg", "esm", "mocha", "idle")] + [("a", "esm", "dev dependency")]
    read = commands.simple_commands(spark.createDataFrame(said, "root string, script string, command string"))
    got = [tuple(r) for r in commands.command_packages(read, spark.createDataFrame(declared, "root string, dep string, dep_kind string")).collect()]
    assert sorted(got) == [("a", "@s/reg"), ("a", "@scope/tool"), ("a", "esm"), ("a", "mocha"), ("a", "webpack"), ("c", "webpack")]


def test_exempt(spark):
    deps = {"a": ["react", "react-dom", "eslint-plugin-x", "left-pad", "x-loader", "@types/node"], "b": ["react", "vue", "nuxt", "loader", "babel-x-parser"], "c": ["isbot", None, "svelte"], "d": ["react-dom", "next", "react"]}
    rows = [(w, d, "dependency") for w, ds in deps.items() for d in ds] + [("c", "@sveltejs/kit", "optional dependency"), ("a", "react", "peer dependency")]
    got = {(r["root"], r["dep"], r["reason"]) for r in exemptions.exempt(spark.createDataFrame(rows, "root string, dep string, dep_kind string")).collect()}
    tools = {("a", "eslint-plugin-x"), ("a", "x-loader"), ("a", "@types/node"), ("b", "babel-x-parser")}
    needed = {("a", "react", "react-dom"), ("a", "react-dom", "react"), ("b", "vue", "nuxt"), ("d", "react-dom", "next"), ("d", "react", "next")}
    assert got == {(*t, "tool") for t in tools} | {(w, d, f"needed by {by}") for w, d, by in needed}
