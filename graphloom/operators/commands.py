"""Commands of manifests' scripts: which files they run, and which packages' programs and modules they use.

A command line is cut into words and separators by one regular expression, command lines in quotes are opened in place (three deep; deeper ones stay one word), and
each simple command is read by one fold whose state knows what its runner expects next. The fold ends in a state that takes the rest as arguments, or nothing of it,
so that long lists of arguments are only filtered. Assignments and programs that run another one (``cross-env``) are looked through. A null or empty command names
nothing; words with ``$`` are no paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Programs that run a file, that fetch and run a package, that run a package's program by a subcommand; options with a value; folders whose files are named bare.
RUNNERS = ("node", "tsx", "ts-node", "tsm", "bun")
FETCHERS = ("npx", "bunx")
MANAGERS = ("pnpm", "yarn", "npm")
EXEC = ("exec", "dlx", "x")
MODULE_OPTIONS = ("-r", "--require", "--loader", "--import")
CODE_OPTIONS = ("-e", "--eval", "-p", "--print")
VALUE_OPTIONS = ("--filter", "-F", "--workspace", "-w", "--cwd", "--prefix")
FOLDERS = ("./", "../", "src/", "scripts/", "bin/", "app/", "lib/", "tools/")
PRODUCTION = ("start", "serve", "prod", "build")
DEVELOPMENT = ("test", "lint", "dev", "storybook", "bench")
#: Programs that run the command after them.
WRAPPERS = ("cross-env", "cross-env-shell", "env", "dotenv", "time")

_WORD_MARK, _COMMAND_MARK, _BACK = "\x01", "\x02", "\x03"
_QUOTED = r""""(?:[^"\\]++|\\.)*+"|'[^']*+'"""
_LEXED = rf"""(?s)(?<!\S)(?:-e|--eval|-p|--print)\s+(?:{_QUOTED})|(?:[^\s&|;"'\\]++|\\.|{_QUOTED})++|[&|;\n]|["']"""
_NESTED = r"""(?s)^(["']).*\s.*\1$"""
_STATE = "struct<at: string, place: int, rest: int, programs: array<string>, modules: array<string>>"


def _lexed(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_LEXED), F.lit(0))


def _opened(words: Column) -> Column:
    """Words, with quoted command lines as commands of their own; what follows one belongs to the command around it."""
    inner = lambda w: F.regexp_replace(F.substring(w, 2, F.length(w) - 2), r'\\"', '"')
    each = lambda w: F.when(w.rlike(_NESTED), F.concat(F.array(F.lit(";")), _lexed(inner(w)), F.array(F.lit(";"), F.lit(_BACK)))).otherwise(F.array(w))
    return F.flatten(F.transform(words, each))


def script_profile(name: Column) -> Column:
    """The profile of a script by its name, or the part of it before a colon."""
    head = F.substring_index(name, ":", 1)
    return F.when(head.isin(*PRODUCTION), "production").when(head.isin(*DEVELOPMENT), "development").otherwise("both")


def _step(s: Column, w: Column) -> Column:
    """The state after a word."""
    at, here = s["at"], s["place"]
    option = w.startswith("-")
    code = w.isin(*CODE_OPTIONS) | w.rlike(r"^(-e|--eval|-p|--print)\s")
    joined = F.regexp_extract(w, r"^(?:-r|--require|--loader|--import)=(.*)$", 1)

    def to(state: str, *, rest: Column | None = None, program: bool = False, module: Column | None = None) -> Column:
        programs = F.concat(s["programs"], F.array(w)) if program else s["programs"]
        modules = s["modules"] if module is None else F.concat(s["modules"], F.array(module))
        return F.struct(F.lit(state).alias("at"), (here + 1).alias("place"), (s["rest"] if rest is None else rest).alias("rest"), programs.alias("programs"), modules.alias("modules")).cast(_STATE)

    begun = (
        F.when(w == _BACK, to("rest", rest=here + 1)).when(w.rlike(r"^[A-Za-z_]\w*=") | (w == "--"), to("start")).when(w.isin(*WRAPPERS), to("start", program=True))
        .when(w == "node", to("node", program=True)).when(w.isin(*RUNNERS), to("runner", program=True)).when(w.isin(*FETCHERS), to("fetch", program=True))
        .when(w.isin(*MANAGERS), to("manager", program=True)).when(option, to("rest", rest=here)).otherwise(to("rest", rest=here, program=True))
    )

    def run(state: str, target: Column) -> Column:
        return F.when(w.isin(*MODULE_OPTIONS), to(f"{state} module")).when(joined != "", to(state, module=joined)).when(code, to("none")).when(option, to(state)).otherwise(target)

    bun = F.element_at(s["programs"], -1) == "bun"
    managed = F.when(w.isin(*VALUE_OPTIONS), to("value")).when(option, to("manager")).when(w.isin(*EXEC), to("start")).when(w == "run", to("script")).otherwise(to("none", program=True))
    return (
        F.when(at.isin("rest", "none"), to("none", rest=s["rest"]).withField("at", at)).when(at == "start", begun).when(at == "node", run("node", to("rest", rest=here)))
        .when(at == "runner", run("runner", F.when(bun & w.isin("run", *EXEC), to("target")).otherwise(to("rest", rest=here, program=True))))
        .when(at == "node module", to("node", module=w)).when(at == "runner module", to("runner", module=w))
        .when(at == "fetch", F.when(option, to("fetch")).otherwise(to("rest", rest=here + 1, program=True)))
        .when(at == "target", F.when(option, to("target")).otherwise(to("rest", rest=here, program=True)))
        .when(at == "script", F.when(option, to("script")).otherwise(to("none", program=True))).when(at == "value", to("manager")).otherwise(managed)
    )


def simple_commands(scripts: DataFrame) -> DataFrame:
    """Rows of ``scripts`` (command and other columns) for each simple command, with its ``programs``, ``modules`` (of options such as ``-r``) and ``arguments``.

    Arguments are the words among which files are: none where the rest isn't a program's own, as in ``npm run``.
    """
    words = reduce(lambda c, _: _opened(c), range(3), _lexed(F.translate("command", "\x01\x02\x03", "   ")))
    marked = F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^[&|;\n]$"), _COMMAND_MARK).otherwise(w)), _WORD_MARK)
    trimmed = lambda w: F.regexp_replace(w, r"""^["'`,;()]+|["'`,;()]+$""", "")
    each = F.transform(F.split(marked, _COMMAND_MARK), lambda c: F.filter(F.transform(F.split(c, _WORD_MARK), trimmed), lambda w: w != ""))
    lists = scripts.select("*", F.explode(F.filter(each, lambda c: F.size(c) > 0)).alias("__words"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("start").alias("at"), F.lit(0).alias("place"), F.lit(0).alias("rest"), none.alias("programs"), none.alias("modules")).cast(_STATE)
    read = lists.withColumn("__s", F.aggregate("__words", start, _step))
    bins = F.filter(F.transform("__words", lambda w: F.regexp_extract(w, r"node_modules/\.bin/([^/\s]+)", 1)), lambda w: w != "")
    rest = F.when(F.col("__s.at") == "rest", F.slice("__words", F.col("__s.rest") + 1, F.size("__words"))).otherwise(none)
    return read.select("*", F.concat("__s.programs", bins).alias("programs"), F.col("__s.modules").alias("modules"), rest.alias("arguments")).drop("__words", "__s")


def command_files(commands: DataFrame) -> DataFrame:
    """Distinct rows (root, script, path, profile) of the paths among the arguments of ``commands`` (root, script, arguments)."""
    named = commands.select("root", "script", F.explode("arguments").alias("word"))
    looks = F.col("word").rlike(r"[^/]\.[cm]?[jt]sx?$") & ~F.col("word").rlike(r"\.[cm][jt]sx$") | reduce(Column.__or__, [F.col("word").startswith(f) for f in FOLDERS])
    kept = named.where(looks & ~F.col("word").startswith("-") & ~F.col("word").contains("$"))
    return kept.select("root", "script", F.regexp_replace("word", r"^(\./+)+", "").alias("path"), script_profile(F.col("script")).alias("profile")).where("path <> ''").distinct()


def command_packages(commands: DataFrame, declared: DataFrame) -> DataFrame:
    """Distinct rows (root, dep) of ``declared`` whose program (a scoped package's is named without the scope) or module ``commands`` (root, programs, modules) use."""
    name = r"^(@[^/]+/[^/]+|[^@./][^/]*)"
    modules = F.transform("modules", lambda m: F.regexp_extract(m, name, 1))
    words = commands.select("root", F.explode(F.array_distinct(F.concat("programs", modules))).alias("word")).distinct()
    known = declared.select("root", "dep", F.explode(F.array_distinct(F.array(F.col("dep"), F.regexp_replace("dep", "^@[^/]+/", "")))).alias("word")).distinct()
    return known.join(words, ["root", "word"]).select("root", "dep").distinct()
