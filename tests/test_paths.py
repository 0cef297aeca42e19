"""Suffix lookup, symbolic links, folder digests and chains against brute force."""

import random

from pyspark.sql import functions as F

from graphloom.operators import chains, paths


def frame(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def test_suffix_lookup(spark):
    rng = random.Random(3)
    files = sorted({"/".join(rng.choice(["a", "ab", "src", "index.ts", "x.index.ts"]) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    asked = {f[-k:] for f in files for k in (1, 4, 8, 11, 13)} | set(files) | {"", "/", "zz", "src/", "/index.ts", "ndex.ts", "b/index.ts", files[0] + "x", "x/" + files[0]}
    got = paths.suffix_lookup(frame(spark, [(q,) for q in [*asked, None, "zz"]], "query string"), frame(spark, [(f,) for f in [*files, None, files[0]]], "rel_path string"))
    rows = [(r["query"], r["rel_path"]) for r in got.collect()]
    want = {q: q if q in files else min((f for f in files if f.endswith(q)), default=None) for q in asked}
    assert dict(rows) == want | {None: None} and len(rows) == len(want) + 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "EndsWith" not in plan


def walked(path, links):
    """Component by component, with a stack of what is still to come."""
    todo, here, n = [p for p in path.split("/") if p not in ("", ".")][::-1], [], 0
    while todo:
        part = todo.pop()
        if part == "..":
            if not here:
                return None, "outside"
            here.pop()
            continue
        here.append(part)
        to = links.get("/".join(here))
        if to is not None:
            n += 1
            if n > 40:
                return None, "loop"
            if to.startswith("/repo/"):
                here, to = [], to[6:]
            elif to.startswith("/"):
                return None, "outside"
            else:
                here.pop()
            todo += [p for p in to.split("/") if p not in ("", ".")][::-1]
    return "/".join(here), "linked" if n else "plain"


def test_links(spark):
    rng = random.Random(5)
    names = ["a", "b", "c", "d"]
    some = lambda n: "/".join(rng.choice(names) for _ in range(n))
    links = {"loop": "loop", "p": "q", "q": "./p", "grow": "grow/a", "out": "../x", "abs": "/etc", "in": "/repo/a/b", "deep/er": "../a/../b/c", "l": "deep/er/../c"}
    for _ in range(12):
        links[some(rng.randint(1, 2))] = rng.choice(["", "../", "./", "../../"]) + some(rng.randint(1, 2)) + rng.choice(["", "/..", "/../" + some(1)])
    asked = {some(rng.randint(1, 5)) for _ in range(120)} | {k + "/a/b" for k in links} | {"x/y.ts", "./x//y.ts", "a/../../z", "..", "l/../b"}
    got = paths.canonical_paths(frame(spark, [(p,) for p in [*asked, None]], "path string"), frame(spark, [*links.items(), (None, "x"), ("x", None)], "path string, target string"), root="/repo")
    rows = {r["path"]: (r["canonical"], r["outcome"]) for r in got.collect()}
    assert rows == {p: walked(p, links) for p in asked} and {"plain", "linked", "loop", "outside"} == {o for _, o in rows.values()}
    none = frame(spark, [], "path string, target string")
    assert paths.canonical_paths(frame(spark, [], "path string"), none).count() == 0
    assert [tuple(r) for r in paths.canonical_paths(frame(spark, [("a/./b",)], "path string"), none).collect()] == [("a/./b", "a/b", "plain")]


def test_files_behind_links(spark):
    files = frame(spark, [("pkgs/a/x.ts",), ("node_modules/a/x.ts",), ("by/b/y.ts",), ("also/b/y.ts",)], "rel_path string")
    links = frame(spark, [("node_modules/a", "../pkgs/a"), ("by/b", "/repo/real/b"), ("also/b", "../by/b")], "path string, target string")
    asked = frame(spark, [("node_modules/a/x.ts",), ("pkgs/a/x.ts",), ("real/b/y.ts",), ("by/b/y.ts",), ("by/b/no.ts",)], "path string")
    got = {r["path"]: r["rel_path"] for r in paths.behind_links(asked, files, links, root="/repo").collect()}
    assert got == {"node_modules/a/x.ts": "pkgs/a/x.ts", "pkgs/a/x.ts": "pkgs/a/x.ts", "real/b/y.ts": "also/b/y.ts", "by/b/y.ts": "also/b/y.ts", "by/b/no.ts": None}


def test_folder_digests(spark):
    files = {"a/x.ts": "1", "a/y.ts": "2", "a/b/c/z.ts": "3", "b/x.ts": "1", "b/y.ts": "2", "top.ts": "4", "e/d": "", "n": None}
    of = lambda f: frame(spark, f.items(), "rel_path string, digest string")
    digests = {r["folder"]: (r["digest"], r["files"]) for r in paths.folder_digests(of(files)).collect()}
    assert {k: n for k, (_, n) in digests.items()} == {"": 8, "a": 3, "a/b": 1, "a/b/c": 1, "b": 2, "e": 1}
    again = {r["folder"]: (r["digest"], r["files"]) for r in paths.folder_digests(of(dict(reversed(files.items()))).repartition(7)).collect()}
    assert again == digests and len({d for d, _ in digests.values()}) == 6
    changed = lambda new: {(r["folder"], r["change"]) for r in paths.changed_folders(of(files), of(new)).collect()}
    assert changed(files) == set()
    assert changed(files | {"a/b/c/z.ts": "5"}) == {("", "changed"), ("a", "changed"), ("a/b", "changed"), ("a/b/c", "changed")}
    swapped = {k: v for k, v in files.items() if k != "e/d"} | {"b/x.ts": "2", "b/y.ts": "1", "f/g/h.ts": "1"}
    assert changed(swapped) == {("", "changed"), ("b", "changed"), ("e", "removed"), ("f", "added"), ("f/g", "added")}
    assert paths.folder_digests(of({"x": "1"}).limit(0)).count() == 0


def end_by_force(links, node):
    seen, at = [node], links[node]
    while at in links and at not in seen:
        seen.append(at)
        at = links[at]
    return (min(seen[seen.index(at):]), None, True) if at in seen else (at, len(seen), False)


def test_chains(spark):
    rng = random.Random(8)
    for links in ({k: k + 1 for k in range(70)}, {k: rng.randrange(90) for k in range(80) if rng.random() < 0.8}, {1: 1, 2: 1, 3: 4, 4: 5, 5: 3, 6: 3, 7: 8}, {k: 0 for k in range(1, 40)}):
        rows = [*links.items(), *((k, v + 500) for k, v in links.items()), (None, 1), (77777, None)]
        got = {r["node"]: (r["end"], r["hops"], r["cyclic"]) for r in chains.chain_ends(frame(spark, rows, "node long, next long")).collect()}
        assert got == {n: end_by_force(links, n) for n in links}
    assert chains.chain_ends(frame(spark, [], "node long, next long")).count() == 0


def test_origins_of_exports(spark):
    rows = [("index", "mid", "a", "a"), ("mid", "impl", "x", "a"), ("index", "ns", "*", "space"), ("top", "index", "space", "s"), ("index", "all", "*", "*"), ("l1", "l2", "q", "q"), ("l2", "l1", "q", "q")]
    got = chains.export_origins(frame(spark, rows, "reexporter string, source string, original string, exported string")).withColumn("hops", F.coalesce("hops", F.lit(-1)))
    assert {tuple(r) for r in got.collect()} == {
        ("index", "a", "impl", "x", 2, False), ("mid", "a", "impl", "x", 1, False), ("index", "space", "ns", "*", 1, False), ("top", "s", "ns", "*", 2, False), ("l1", "q", "l1", "q", -1, True), ("l2", "q", "l1", "q", -1, True),
    }
