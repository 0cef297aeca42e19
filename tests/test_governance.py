"""Hotspots with teams against a count by hand, and all kinds of actions."""

import random

from graphloom.operators import governance as G


def test_team_hotspots(spark):
    draw = random.Random(5)
    files = [(k, f"p{draw.randrange(4)}" if k % 9 else None, draw.choice(["a", "b", None])) for k in range(40)]
    edges = list({(min(draw.randrange(40), draw.randrange(40)), draw.randrange(40), draw.choice(["StaticImportValue", "DynamicImport", "RequireContext"])) for _ in range(300)})
    edges += [(k, 39, "StaticImportValue") for k in range(12)] + edges[:5]  # a hub, and repeated rows
    of = {k: (p, o) for k, p, o in files}
    want = []
    for k, package, owner in files:
        near = [(d, 0) for s, d, t in set(edges) if s == k and t != "RequireContext"] + [(s, 1) for s, d, t in set(edges) if d == k and t != "RequireContext"]
        fan_in, total = sum(i for _, i in near), len(near)
        cross = sum(package is not None and of[n][0] not in (None, package) for n, _ in near)
        owners = sum(owner is not None and of[n][1] not in (None, owner) for n, _ in near)
        out = total - fan_in
        advice = "share-ownership" if owners > total // 3 else "extract-package" if cross > total // 2 else "define-surface" if fan_in > 3 * out > 0 else "split" if out > 3 * fan_in > 0 else "review"
        if total >= 5:
            want.append((-total, -owners, k, fan_in, out, cross, owners, sorted({of[n][1] for n, _ in near} | {owner} - {None} if owner else {of[n][1] for n, _ in near}, key=str), advice))
    want = [(*w[2:7], [t for t in w[7] if t], w[8], r) for r, w in enumerate(sorted(want, key=lambda w: w[:3])[:20], 1)]
    frame = spark.createDataFrame(edges, "src long, dst long, kind string"), spark.createDataFrame(files, "file_id long, package string, owner string")
    got = sorted((tuple(r) for r in G.team_hotspots(*frame).collect()), key=lambda r: r[-1])
    assert got == want and len({w[6] for w in want}) >= 3
    assert G.team_hotspots(frame[0].limit(0), frame[1]).count() == 0


def test_governance_actions(spark):
    f = spark.createDataFrame
    sets = {
        "suggestions": f([("high",), ("low",), ("high",)], "confidence string"), "hints": f([("x", 4), ("y", 5)], "folder string, edges long"), "tags": f([("file-pattern",), ("package",), ("package",)], "source string"),
        "hot": f([("a", 10, 10), ("b", 7, 7), ("c", 15, 0), ("d", 0, 20), ("e", 9, 9)], "file_id string, fan_in long, fan_out long"), "layered": f([("t",)], "top string"), "fenced": f([("p",), ("q",)], "package string"),
    }
    assert [tuple(r) for r in G.governance_actions(**sets).orderBy("priority").collect()] == [
        (1, "add-boundary-rule", "low", "high", 2, ""), (2, "assign-ownership", "medium", "high", 2, "9 edges between areas"), (3, "split-hotspot", "high", "high", 4, "a (20 edges), d (20 edges), e (18 edges)"),
        (4, "introduce-tags", "low", "medium", 3, "2 package, 1 file-pattern"), (5, "enforce-layering", "low", "medium", 1, ""), (6, "add-reachability-fence", "low", "medium", 2, ""),
    ]
    assert G.governance_actions(**{k: v.limit(0) for k, v in sets.items()}).count() == 0
    some = sets | {"suggestions": sets["suggestions"].where("confidence = 'low'"), "hints": sets["hints"].limit(0)}
    assert [r["kind"] for r in G.governance_actions(**some).orderBy("priority").collect()][:2] == ["split-hotspot", "introduce-tags"]
