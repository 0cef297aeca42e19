"""A folder with symbolic links and names that files pass on, from the walk to what imports resolve to."""

import json
import os

from graphloom.plans.scan import Scan
from graphloom.sources.repo import symlinks, walk

FILES = {
    "package.json": json.dumps({"name": "app", "main": "src/index.ts"}),
    "src/index.ts": "import { a } from './ext/util';\nimport './ext';\nimport './short';\nimport './round/x';\nexport { a as shown };\nexport * as space from './ext/util';",
    "shared/index.ts": "export { a as again } from './util';", "shared/util.ts": "export { deep as a } from './deep/d';", "shared/deep/d.ts": "export const deep = 1;",
    "src/real.ts": "", "other/shared/util.ts": "", "src/x/y/util.ts": "",
}


def test_links_and_origins(spark, tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    os.symlink("../shared", tmp_path / "src/ext")
    os.symlink(tmp_path / "src/real.ts", tmp_path / "src/short.ts")
    os.symlink("/elsewhere", tmp_path / "src/out")
    os.symlink("round", tmp_path / "src/round")
    root = f"file://{tmp_path}"
    links = symlinks(spark, root)
    assert {tuple(r) for r in links.collect()} == {("src/ext", "../shared"), ("src/short.ts", "real.ts"), ("src/out", "/elsewhere"), ("src/round", "round")}
    os.unlink(tmp_path / "src/out")  # these two stop a listing that follows them
    os.unlink(tmp_path / "src/round")
    rows = walk(spark, root, links=links)
    assert {r["rel_path"] for r in rows.collect()} == set(FILES)
    scan = Scan(rows, symlinks=links)
    got = {(r["src"], r["specifier"]): r["dst_file"] for r in scan.resolutions.collect()}
    assert got == {
        ("src/index.ts", "./ext/util"): "shared/util.ts", ("src/index.ts", "./ext"): "shared/index.ts", ("src/index.ts", "./short"): "src/real.ts", ("src/index.ts", "./round/x"): None,
        ("shared/index.ts", "./util"): "shared/util.ts", ("shared/util.ts", "./deep/d"): "shared/deep/d.ts",
    }
    origins = {(r["file"], r["name"]): (r["origin"], r["original"], r["hops"]) for r in scan.origins.collect()}
    assert origins == {
        ("shared/util.ts", "a"): ("shared/deep/d.ts", "deep", 1), ("shared/index.ts", "again"): ("shared/deep/d.ts", "deep", 2),
        ("src/index.ts", "shown"): ("shared/deep/d.ts", "deep", 2), ("src/index.ts", "space"): ("shared/util.ts", "*", 1),
    }
    assert {tuple(r) for r in scan.find("util.ts", "y/util.ts", "src/real.ts", "none.ts").collect()} == {("util.ts", "other/shared/util.ts"), ("y/util.ts", "src/x/y/util.ts"), ("src/real.ts", "src/real.ts"), ("none.ts", None)}
