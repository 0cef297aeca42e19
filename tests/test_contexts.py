"""Folders' files by expressions: the text that an expression begins with is a key, so many expressions over a large folder make no product."""

import re

from pyspark.sql import functions as F

from graphloom.sources import config

REGEXES = [r"^\./f12\.ts$", r"^\./.*$", r"\.ts$", r"^\./(a|f1)2\.ts$", r"^\./a|f2", r"^\./[(]|f3", r"^\./f1*2", r"^\./f{1}4", r"^\./d/f\d+\.ts$", r"^./f5", "^", r"^\./f7?8", r"^\.\/f9|^\./f10"]


def test_heads_and_many_contexts(spark):
    paths = [f"src/f{i}.ts" for i in range(300)] + ["src/d/f1.ts", "src/d/e/f12.ts", "f12.ts", "other/f12.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    rest = F.concat(F.lit("."), F.expr("if(base = '', concat('/', path), substring(path, length(base) + 1))"))
    asked = spark.createDataFrame([(base, r, deep) for r in REGEXES for base in ("src", "") for deep in (True, False)], "base string, regex string, deep boolean")
    got = {(r["base"], r["regex"], r["deep"], r["path"]) for r in config.begun(config.headed(asked), files, rest).where(F.expr("subject rlike regex")).collect()}
    inside = lambda p, base, deep: (not base or p.startswith(base + "/")) and (deep or p.rpartition("/")[0] == base)
    assert got == {(b, r, d, p) for b in ("src", "") for d in (True, False) for r in REGEXES for p in paths if inside(p, b, d) and re.search(r, "./" + p[len(b) :].lstrip("/"))}
    many = spark.createDataFrame([("src", rf"^\./f{i}\.ts$", False) for i in range(300)], "base string, regex string, deep boolean")
    assert config.begun(config.headed(many), files, rest).count() == 300
