"""Ignore files of a tree: which paths the rules of all folders above them take out.

A rule belongs to the folder of its file and is held against paths below it. A path may be taken out itself, or lie below a folder that is:
inside such a folder no rule brings anything back. So each folder is taken apart into its prefixes (the folders above, and itself); for each prefix
the last rule of the deepest folder that fits decides; and a folder is out if one of its prefixes is. Rules meet folders by an equi join on the
rule's folder. A path meets its folder, and the rules of the folders above that fit it decide, unless that folder is out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE = "base string, ordinal int, pattern string, regex string, negated boolean, folders_only boolean"


def ignore_regex(body: str) -> str:
    """A pattern as an expression over paths from its file's folder. A slash but at the end ties it to that folder; else it fits a name at any depth."""
    tied = "/" in body.rstrip("/")
    body = body.strip("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out.append(".+")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            inner = "^/" + inner[1:] if inner[0] in "!^" else inner
            out.append("[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out.append(re.escape(body[i + 1]))
            i += 2
        else:
            out.append(re.escape(body[i]))
            i += 1
    return ("^" if tied else "^(?:.*/)?") + "".join(out) + "$"


def parsed(text: str) -> list[tuple[int, str, str, bool, bool]]:
    """(ordinal, pattern, regex, negated, folders_only) of a file's lines; blank lines and comments are none."""
    out = []
    for k, line in enumerate(text.splitlines()):
        body = re.sub(r"(?<!\\) +$", "", line)
        if not body or body.startswith("#"):
            continue
        negated = body.startswith("!")
        pattern = body[1:] if negated else body
        if pattern.strip("/"):
            out.append((k, pattern, ignore_regex(pattern), negated, pattern.endswith("/")))
    return out


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rows of ``RULE`` of ignore files (rel_path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows = [(path.rpartition("/")[0], *r) for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in parsed(text or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["base", "ordinal", "pattern", "regex", "negated", "folders_only"])

    return files.select("rel_path", "text").mapInArrow(run, RULE)


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The ``rel_path`` of ``paths`` that the rules take out, each once."""
    parts = F.split("rel_path", "/")
    files = paths.select("rel_path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), (F.size(parts) - 1).alias("deep"))
    folders, above = files.select("folder", "deep").distinct(), F.split("folder", "/")
    upto = lambda n: F.array_join(F.slice(above, 1, n), "/")
    each = folders.where("deep > 0").select("folder", "deep", F.explode(F.transform(F.sequence(F.lit(1), F.col("deep")), upto)).alias("prefix"))
    up = F.split("prefix", "/")
    bases = F.transform(F.sequence(F.lit(0), F.size(up) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(up, 1, n), "/").alias("base")))
    asked = each.select("prefix").distinct().select("prefix", F.explode(bases).alias("b")).select("prefix", "b.*")
    inside = F.when(F.col("base") == "", F.col("prefix")).otherwise(F.expr("substring(prefix, length(base) + 2)"))
    met = asked.join(rules, "base").withColumn("inside", inside).where(F.expr("inside rlike regex"))
    out = met.groupBy("prefix").agg(F.max_by("negated", F.struct("depth", "ordinal")).alias("negated")).where("not negated").select("prefix")
    gone = each.join(out, "prefix").select("folder", "deep").distinct().withColumn("gone", F.lit(True))
    # The rules that a folder's own files meet, the last that counts first; so files themselves are neither taken apart nor grouped.
    own = folders.select("folder", "deep", F.explode(F.sequence(F.lit(0), F.col("deep"))).alias("depth")).withColumn("base", upto(F.col("depth"))).join(rules.where("not folders_only"), "base")
    last = own.groupBy("folder", "deep").agg(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "ordinal", "base", "regex", "negated")))).alias("rules"))
    known = folders.join(gone, ["folder", "deep"], "left").join(last, ["folder", "deep"], "left").where("gone or rules is not null")
    hit = F.expr("get(filter(rules, r -> if(r.base = '', rel_path, substring(rel_path, length(r.base) + 2)) rlike r.regex), 0).negated")
    return files.join(known, ["folder", "deep"]).where(F.col("gone").isNotNull() | ~hit).select("rel_path").distinct()
