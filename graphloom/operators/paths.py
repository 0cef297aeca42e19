"""Paths as keys: lookup by suffix, symbolic links, digests of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.tables import Rounds

#: A path that passes more links than this is a loop, as systems have it.
MOST_LINKS = 40
#: Digests are added as eight numbers of 32 bits, so the sums of two thousand million entries stay in a long.
WORDS = [f"w{i}" for i in range(8)]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix_lookup(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(query, rel_path) for every distinct ``query`` of ``asked``: the file of that path, else the least path that ends in it, else null.

    Suffixes are keys: what holds a slash ends in a whole base name, so a path gives only suffixes of the lengths that are asked for its own base name;
    the others are looked up among suffixes of distinct base names, each with its least path. Suffixes are reduced to their least path before they meet the
    queries, so both sides of that join are unique, and a base name of a third of all files costs a partial aggregate. The empty query fits all files.
    """
    queries = asked.select("query").distinct()
    paths = files.select("rel_path").where("rel_path is not null").distinct()
    named = paths.withColumn("base", base_name(F.col("rel_path")))
    lengths = queries.where("contains(query, '/')").groupBy(base_name(F.col("query")).alias("base")).agg(F.collect_set(F.length("query")).alias("lengths"))
    deep = named.join(lengths, "base").select("rel_path", F.explode("lengths").alias("n")).where("length(rel_path) >= n").select(F.expr("right(rel_path, n)").alias("suffix"), "rel_path")
    least = named.groupBy("base").agg(F.min("rel_path").alias("rel_path"))
    flat = least.select("rel_path", F.explode(F.expr("transform(sequence(0, length(base)), n -> right(base, n))")).alias("suffix"))
    found = deep.unionByName(flat).groupBy("suffix").agg(F.min("rel_path").alias("__ends"))
    exact = paths.select(F.col("rel_path").alias("__exact"))
    out = queries.join(exact, F.col("query") == F.col("__exact"), "left").join(found, F.col("query") == F.col("suffix"), "left")
    return out.select("query", F.coalesce("__exact", "__ends").alias("rel_path"))


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def canonical_paths(paths: DataFrame, links: DataFrame, *, root: str = "") -> DataFrame:
    """(path, canonical, outcome) for every distinct ``path``: where it leads through ``links`` (path, target), folder by folder as a system goes.

    outcome: ``plain`` if no link is passed, ``linked``, ``loop`` (comes back to a path, or passes over forty links), ``outside`` (leaves the repository;
    ``canonical`` is null for both). A target is relative to the folder of its link, or absolute: below ``root`` it is taken into the repository. ``..`` goes up from
    where a link has led, not from where it stands. Of several targets of one link the least counts. What has arrived isn't read again.

    A round takes one step of every open path: the shortest part before the first ``..`` that is a link is replaced, or the ``..`` are taken back.
    """
    rounds = Rounds(paths.sparkSession)
    target = F.col("target")
    if root:
        target = F.when(target == root, F.lit(".")).when(target.startswith(root + "/"), F.concat(F.lit("//"), F.substring(target, len(root) + 2, 1 << 20))).otherwise(target)
    known = rounds.table(links.where("path is not null and target is not null").groupBy(F.array_join(_parts(F.col("path")), "/").alias("__link")).agg(F.min(target).alias("__to")))
    start = paths.select("path").where("path is not null").distinct()
    state, n = rounds.counted(start.select("path", _parts(F.col("path")).alias("now"), F.array().cast("array<string>").alias("trail"), F.lit("open").alias("outcome")))
    done = []
    while n:
        live = state.where("outcome = 'open'")
        up = F.array_position("now", F.lit("..")).cast("int")
        upto = F.when(up == 0, F.size("now")).otherwise(up - 1)
        heads = F.when(upto > 0, F.transform(F.sequence(F.lit(1), upto), lambda k: F.array_join(F.slice("now", 1, k), "/")))
        hits = live.select("path", F.posexplode(heads).alias("at", "__link")).join(known, "__link").groupBy("path").agg(F.min(F.struct("at", "__to")).alias("hit"))
        rows = live.join(hits.withColumnRenamed("path", "__path"), F.col("path") == F.col("__path"), "left").withColumn("up", up)
        to, at = F.col("hit.__to"), F.col("hit.at")
        inside = to.startswith("//")
        folder = F.when(inside, F.array().cast("array<string>")).otherwise(F.slice("now", 1, at))
        led = F.concat(folder, _parts(to), F.slice("now", at + 2, F.size("now")))
        run = F.expr("coalesce(nullif(array_position(transform(slice(now, up, size(now)), p -> p = '..'), false), 0) - 1, size(now) - up + 1)").cast("int")
        back = F.concat(F.slice("now", 1, F.greatest(F.col("up") - 1 - run, F.lit(0))), F.slice("now", F.col("up") + run, F.size("now")))
        hit = F.col("hit").isNotNull()
        then = F.when(hit, led).when(F.col("up") > 0, back).otherwise(F.col("now"))
        name = F.array_join(then, "/")
        again = hit & (F.array_contains("trail", name) | (name == F.array_join("now", "/")) | (F.size("trail") >= MOST_LINKS))
        left = F.when(hit, to.startswith("/") & ~inside).otherwise((F.col("up") > 0) & (run > F.col("up") - 1))
        outcome = F.when(left, "outside").when(again, "loop").when(hit | (F.col("up") > 0), "open").when(F.size("trail") > 0, "linked").otherwise("plain")
        step = rows.select("path", then.alias("now"), F.when(hit, F.concat("trail", F.array(F.array_join("now", "/")))).otherwise(F.col("trail")).alias("trail"), outcome.alias("outcome"))
        state, n = rounds.counted(step, F.col("outcome") == "open")
        done.append(state.where("outcome <> 'open'"))
    if not done:
        return start.select("path", F.col("path").alias("canonical"), F.lit("plain").alias("outcome"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("path", F.when(F.col("outcome").isin("plain", "linked"), F.array_join("now", "/")).alias("canonical"), "outcome")


def behind_links(paths: DataFrame, files: DataFrame, links: DataFrame, *, root: str = "") -> DataFrame:
    """(path, rel_path): the file of the repository behind each path, through links where there are any; null if there is none.

    Files may be listed under links, too: then the file at the canonical path stands for all of one canonical path, and the least of them where it isn't listed.
    """
    every = paths.select("path").unionByName(files.select(F.col("rel_path").alias("path")))
    where = Rounds(paths.sparkSession).table(canonical_paths(every, links, root=root).where("canonical is not null").select("path", "canonical"))
    listed = files.select(F.col("rel_path").alias("path")).distinct().join(where, "path")
    original = listed.groupBy("canonical").agg(F.min(F.struct(F.col("path") != F.col("canonical"), "path")).alias("__o")).select("canonical", F.col("__o.path").alias("rel_path"))
    return paths.select("path").distinct().join(where, "path", "left").join(original, "canonical", "left").select("path", "rel_path")


def folder_digests(files: DataFrame) -> DataFrame:
    """(folder, files, digest) of every folder above ``files`` (rel_path, digest); the repository itself is the folder ``''``.

    A folder's digest adds those of its entries (kind, name and digest), so it has no order, is a partial aggregate, and a folder of a third of all
    files gathers nothing. Files are read once; then folders are put together level by level, deepest first. A repeated row counts as often as it stands there.
    """
    rounds = Rounds(files.sparkSession)
    parts = F.split("rel_path", "/")
    rows = files.where("rel_path is not null").select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), (F.size(parts) - 1).alias("depth"), *_words(F.lit("f"), base_name(F.col("rel_path")), F.coalesce(F.col("digest").cast("string"), F.lit(""))))
    sums = [F.sum(w).alias(w) for w in WORDS]
    own = rounds.table(rows.groupBy("folder", "depth").agg(*sums, F.count("*").alias("entries"), F.count("*").alias("files")))
    deepest = own.agg(F.max("depth")).first()[0]
    level, out = None, []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = own.where(F.col("depth") == depth).drop("depth")
        if level is not None:
            up = F.split("folder", "/")
            parent = F.array_join(F.slice(up, 1, F.size(up) - 1), "/")
            here = here.unionByName(level.select(parent.alias("folder"), *_words(F.lit("d"), base_name(F.col("folder")), F.col("digest")), F.lit(1).cast("long").alias("entries"), "files"))
        both = here.groupBy("folder").agg(*sums, F.sum("entries").alias("entries"), F.sum("files").alias("files"))
        level = rounds.table(both.select("folder", "files", F.sha2(F.concat_ws(",", *WORDS, "entries"), 256).alias("digest")))
        out.append(level)
    if not out:
        return own.select("folder", "files", F.lit("").alias("digest"))
    all_levels = out[0]
    for more in out[1:]:
        all_levels = all_levels.unionByName(more)
    return all_levels


def _words(kind: Column, name: Column, digest: Column) -> list[Column]:
    whole = F.sha2(F.concat_ws("/", kind, name, digest), 256)  # names hold no slash
    return [F.conv(F.substring(whole, 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(WORDS)]


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, change, digest_before, digest_after) of folders that two snapshots (rel_path, digest) have not alike: added, removed or changed."""
    a = folder_digests(before).select("folder", F.col("digest").alias("digest_before"))
    b = folder_digests(after).select("folder", F.col("digest").alias("digest_after"))
    change = F.when(F.col("digest_before").isNull(), "added").when(F.col("digest_after").isNull(), "removed").otherwise("changed")
    return a.join(b, "folder", "full_outer").where("not digest_before <=> digest_after").select("folder", change.alias("change"), "digest_before", "digest_after")
