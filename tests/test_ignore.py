"""Ignore files against a brute force over random trees, and by git itself where it is there."""

import random
import re
import shutil
import subprocess

import pytest

from graphloom.sources.ignore import ignore_rules, ignored, parsed

NAMES = ["a", "b", "src", "dist", "x.js", "y.ts", "log.txt", "a b", "[z]"]
LINES = ["dist", "/dist", "dist/", "*.js", "!x.js", "src/*", "!src/y.ts", "**/a", "a/**", "a/**/b", "!a", "# a", "", "\\#x", "*.t?", "[a-b]", "![!a]", "src/a/", "!src/a/", "/*", "!/src", "log.txt  ", "\\[z\\]"]


def by_force(paths, files):
    """Each path from the top down: is the folder out, or else does the last fitting rule of the folders above take it out?"""
    rules = {path.rpartition("/")[0]: parsed(text) for path, text in files.items()}

    def judged(prefix, is_folder):
        parts = prefix.split("/")
        verdict = False
        for depth in range(len(parts)):
            base = "/".join(parts[:depth])
            for _, _, regex, negated, folders_only in rules.get(base, []):
                if (is_folder or not folders_only) and re.search(regex, "/".join(parts[depth:])):
                    verdict = not negated
        return verdict

    out = set()
    for path in paths:
        parts = path.split("/")
        if any(judged("/".join(parts[:n]), n < len(parts)) for n in range(1, len(parts) + 1)):
            out.add(path)
    return out


def tree(rng):
    paths = {"/".join(rng.choice(NAMES) for _ in range(rng.randint(0, 3))) + "/" + rng.choice(NAMES) for _ in range(40)}
    paths = {p.lstrip("/") for p in paths}
    folders = {p.rpartition("/")[0] for p in paths}
    folders |= {"/".join(f.split("/")[:n]) for f in folders for n in range(len(f.split("/")))}
    paths = sorted(p for p in paths if p not in folders)  # no path is file and folder
    chosen = rng.sample(sorted(folders), min(3, len(folders)))
    return paths, {f"{f}/.gitignore".lstrip("/"): "\n".join(rng.sample(LINES, 6)) for f in chosen}


def found(spark, paths, files):
    rules = ignore_rules(spark.createDataFrame([*files.items()], "rel_path string, text string"))
    return {r["rel_path"] for r in ignored(spark.createDataFrame([(p,) for p in paths], "rel_path string"), rules).collect()}


def test_random_trees(spark, tmp_path):
    rng = random.Random(7)
    for k in range(6):
        paths, files = tree(rng)
        want = by_force(paths, files)
        assert found(spark, paths, files) == want
        if shutil.which("git"):
            root = tmp_path / str(k)
            for path, text in [*((p, "") for p in paths), *files.items()]:
                (root / path).parent.mkdir(parents=True, exist_ok=True)
                (root / path).write_text(text)
            subprocess.run(["git", "init", "-q", root], check=True)
            said = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", "ls-files", "-o", "-i", "-z", "--exclude-per-directory=.gitignore"], capture_output=True, text=True, check=True).stdout
            assert {p for p in said.split("\0") if p and not p.endswith(".gitignore")} == want


def test_a_folder_that_is_out_brings_nothing_back(spark):
    files = {".gitignore": "out/\n!out/keep.ts\n*.gen.ts\n", "src/.gitignore": "!own.gen.ts\n/only-here\n"}
    paths = ["out/keep.ts", "src/own.gen.ts", "src/a/other.gen.ts", "src/only-here", "src/a/only-here", "a/out/b.ts", "a/b.ts"]
    assert found(spark, paths, files) == {"out/keep.ts", "src/a/other.gen.ts", "src/only-here", "a/out/b.ts"}


@pytest.mark.parametrize("paths,files", [([], {".gitignore": "*"}), (["a"], {}), (["a"], {".gitignore": ""})])
def test_nothing(spark, paths, files):
    assert found(spark, paths, files) == set()
