"""Near duplicates by a MinHash LSH forest, with exact confirmation.

A document's set holds its distinct shingles. Equal sets become one class, whose representative is the smallest id. Each representative
gets ``TREES * STEP`` MinHash values, and each tree of the forest orders all representatives by those values from a place of its own on.
Neighbours in such an order share the longest prefixes, and documents of similarity s share a prefix of d values with probability s^d.

1. Runs of neighbours that share ``STEP`` values or more are regions; documents in no region of any tree are done. Only the others'
   sets are built.
2. In the first ``FIRST`` trees every region is cut into blocks of ``BLOCK`` documents at most, where the shared prefixes are shortest:
   dense regions use deeper prefixes, sparse ones shallow ones. Each block is compared on full sets, pivots first: a pivot meets every
   document that isn't linked with it yet. Links become components.
3. Then all trees are read again, with what is known: regions of one component are done. In larger regions a component is stood for
   by the documents with most links, and by those beside documents of other components, which are their longest-prefix neighbours.
   Blocks are compared as before, so that what is left over meets the centres of the groups near it.
4. What blocks left out is made good: in every region larger than a block that still has several components, documents go that have so
   many shingles of their own that they can't be similar to another one; each other document outside the region's main component is
   compared with what is left of the region, tile by tile. A region's main component is never compared with itself. Regions of very many
   documents are met at deeper prefixes.

Links are confirmed on full sets only (100 * intersection >= 75 * union), so no pair is linked wrongly; with 24 trees of depth three a
pair at the least similarity meets in a region with probability 1 - 2e-6, a more similar one with higher.

No task holds more than a block, a tile or a sort partition, no row is a pair of copies, and components are found by joins on the cluster.

Defined cases: null, empty and wordless texts have empty sets and are linked with nothing; a null id keeps its row, is linked with
nothing and has a null component (and is kept); rows that repeat an id and text are one class; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import NEAR_PERCENT, SHINGLE_WORDS, HashCache, Workspace, freed, shingle_set, slices

TREES, STEP, DEPTH, FIRST = 24, 3, 6, 4
#: Most documents and (beyond two documents) shingles of a block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
#: Most documents of a tile, and of a region that is met at its depth; a region of more is met at deeper prefixes.
TILE, DENSE = 1024, 1 << 14
#: Rows of the orders that one sort partition holds, about.
SORT_ROWS = 500_000
#: Documents that stand for a component in a large region, by links.
PIVOTS = 6

_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1 << 62, (1 << 64) - 1, TREES * STEP, dtype=np.uint64, endpoint=True) | np.uint64(1)
_ADD = _RNG.integers(0, (1 << 64) - 1, TREES * STEP, dtype=np.uint64, endpoint=True)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a non-empty set."""
    out = np.full(len(_ADD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, (_MULTIPLY[:, None] * shingles[None, at : at + 1024] + _ADD[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sets(texts: pa.Array, cache: HashCache, words: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(cache.of(text.as_buffer().to_pybytes().lower().split()), words) if text.is_valid else np.empty(0, np.uint64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, sig) of rows (doc_id, text binary); empty sets have a null digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            n, digests, sigs = [], [], []
            for s in _sets(batch.column(1), cache, words):
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])
        cache.clear()
        freed()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def tree_rows(reps: DataFrame) -> DataFrame:
    """Rows (tree, key, rep, n): a representative's place in every order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = TREES * STEP
        order = np.array([[(t * STEP + k * (STEP if k >= STEP else 1) + (t if k >= STEP else 0)) % width for k in range(DEPTH)] for t in range(TREES)])
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, width)
            keys = sigs[:, order].astype(">u4")  # documents, trees, values
            m = len(sigs)
            raw = pa.Array.from_buffers(pa.binary(4 * DEPTH), m * TREES, [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())
            trees = pa.array(np.tile(np.arange(TREES, dtype=np.int32), m))
            yield pa.RecordBatch.from_arrays([trees, raw, pa.array(np.repeat(batch.column(0).to_numpy(), TREES)), pa.array(np.repeat(batch.column(2).to_numpy(), TREES))], ["tree", "key", "rep", "n"])

    return reps.select("rep", "sig", "n").mapInArrow(run, "tree int, key binary, rep long, n long")


def _sorted_partition(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray] | None:
    """A partition's rows, and how many values each row's key shares with the row before it (0 for another tree)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    table = pa.Table.from_batches(parts).combine_chunks()
    keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u4").reshape(-1, DEPTH)
    trees = table.column("tree").to_numpy()
    shared = np.zeros(len(keys), np.int64)
    same = (keys[1:] == keys[:-1]) & (trees[1:] == trees[:-1])[:, None]
    shared[1:] = np.cumprod(same, axis=1).sum(axis=1)
    return table, shared


def in_order(rows: DataFrame, n_rows: int) -> DataFrame:
    """The orders of all trees, dealt so that no partition gets many more than ``SORT_ROWS`` rows."""
    by = ("tree", "key", "rep")
    parts = -(-n_rows // SORT_ROWS)
    dealt = rows.repartitionByRange(parts, *by) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def region_rows(rows: DataFrame, n_rows: int) -> DataFrame:
    """Those rows of the orders that share a prefix with a neighbour. A run at a partition's edge may go on in the next, so its rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _sorted_partition(batches)) is None:
            return
        table, shared = found
        near = shared >= STEP
        keep = near | np.append(near[1:], False)
        keep[0] = keep[-1] = True
        yield from table.filter(pa.array(keep)).to_batches()

    return in_order(rows, n_rows).mapInArrow(run, "tree int, key binary, rep long, n long")


def _blocks(start: int, end: int, shared: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
    """Cuts the rows start to end, which share ``depth`` values, where the next depth ends, and puts small parts that follow together."""

    def fits(a: int, b: int) -> bool:
        return b - a <= 2 or (b - a <= BLOCK and n[a:b].sum() <= BLOCK_SHINGLES)

    if fits(start, end):
        yield start, end
        return
    if depth >= DEPTH:
        while start < end:
            stop = min(end, start + BLOCK)
            while not fits(start, stop):
                stop = start + max(2, (stop - start) // 2)
            yield start, stop
            start = stop
        return
    edges = [start, *(start + 1 + np.flatnonzero(shared[start + 1 : end] <= depth)).tolist(), end]
    held = start
    for a, b in zip(edges, edges[1:], strict=False):
        if not fits(held, b):
            if held < a:
                yield held, a
            if fits(a, b):
                held = a
            else:
                yield from _blocks(a, b, shared, n, depth + 1)
                held = b
    if held < end:
        yield held, end


def _standing(comp: np.ndarray, deg: np.ndarray) -> np.ndarray:
    """Which rows of a large region stand for it: documents of most links of each component, and neighbours of other components."""
    keep = np.zeros(len(comp), bool)
    order = np.lexsort((-deg, comp))
    first = np.concatenate([[0], np.flatnonzero(np.diff(comp[order])) + 1])
    sizes = np.diff(np.append(first, len(comp)))
    keep[order[(np.arange(len(comp)) - np.repeat(first, sizes)) < PIVOTS]] = True
    for k in (1, 2):
        other = comp[k:] != comp[:-k]
        keep[k:] |= other
        keep[:-k] |= other
    return keep


def block_rows(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows (tree, block, rep, comp) of rows (tree, key, rep, n, comp, deg): regions of several components, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _sorted_partition(batches)) is None:
            return
        table, shared = found
        tree, rep, n, comp, deg = (table.column(c).to_numpy() for c in ("tree", "rep", "n", "comp", "deg"))
        out: list[np.ndarray] = []
        blocks: list[np.ndarray] = []
        edges = [*np.flatnonzero(shared < STEP).tolist(), len(rep)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2 or (comp[a:b] == comp[a]).all():
                continue
            at = np.arange(a, b)
            if b - a > BLOCK:
                at = at[_standing(comp[a:b], deg[a:b])]
            # What two rows share is the least that lies between them.
            lcp = np.minimum.reduceat(shared[a + 1 : b], at[:-1] - a) if len(at) == b - a else np.array([shared[x + 1 : y + 1].min() for x, y in zip(at, at[1:], strict=False)])
            lcp = np.concatenate([[0], lcp])
            for x, y in _blocks(0, len(at), lcp, n[at], STEP):
                part = at[x:y]
                if len(part) > 1 and (comp[part] != comp[part[0]]).any():
                    out.append(part)
                    blocks.append(np.full(len(part), rep[part[0]]))
        if out:
            at = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(tree[at]), pa.array(np.concatenate(blocks)), pa.array(rep[at]), pa.array(comp[at])], ["tree", "block", "rep", "comp"])

    return in_order(rows, n_rows).mapInArrow(run, "tree int, block long, rep long, comp long")


def unshared(reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (rep, own) of rows (rep): how many shingles of its set none of the other documents has (left out where there are none)."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sizes = np.asarray(pc.binary_length(batch.column(1)), np.int64) // 8
            shingles = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(shingles)], ["rep", "g"])

    each = sets.join(reps.hint("shuffle_hash"), "rep", "left_semi").mapInArrow(unpacked, "rep long, g long")
    return each.groupBy("g").agg(F.count("*").alias("k"), F.min("rep").alias("rep")).where("k = 1").groupBy("rep").agg(F.count("*").alias("own"))


def remaining(rows: DataFrame, sets: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """Rows (tree, block, rep, comp, asks) of rows (tree, key, rep, n, comp): the tiles of regions that blocks can't hold whole.

    A document that could reach ``percent`` with none of the others goes first: a shingle that no other document of these regions has is
    in no intersection, and in every union. ``asks`` tells the documents outside the region's main component; each of them shares one
    tile with every document of the region that is left. Regions of more than ``DENSE`` documents are met at the next deeper prefix, as
    far as ``DEPTH``. Regions are met by parts of their documents, so that a region of most rows is no single join key.
    """
    parts = 64
    named = rows.select("tree", "key", F.substring("key", 1, 4 * STEP).alias("region"), "rep", "n", "comp").withColumn("h", F.xxhash64("rep")).withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))

    def mixed_regions(of: DataFrame) -> DataFrame:
        held = of.groupBy("tree", "region", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
        most = F.max(F.struct("m", F.col("n").alias("of"), (-F.col("comp")).alias("main"))).alias("most")
        found = held.groupBy("tree", "region").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), most).where(F.col("m") > F.col("most.m"))
        return found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    large = mixed_regions(named).where((F.col("m") > BLOCK) | (F.col("n") > BLOCK_SHINGLES)).select("tree", "region", "part")
    there = space.table(named.join(large, ["tree", "region", "part"], "left_semi"), "large")
    alone = unshared(there.select("rep").distinct(), sets)
    left = space.table(there.join(alone, "rep", "left").where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n")).drop("own"), "comparable")
    for depth in range(STEP + 1, DEPTH + 1):
        dense = left.groupBy("tree", "region").count().where(F.col("count") > DENSE)
        if dense.isEmpty():
            break
        dense = dense.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        region = F.when(F.col("count").isNull(), F.col("region")).otherwise(F.substring("key", 1, 4 * depth)).alias("region")
        left = space.table(left.join(dense, ["tree", "region", "part"], "left").select("tree", "key", region, "rep", "n", "comp", "h", "part"), "deeper")
    pieces = lambda m, n: F.ceil(F.greatest(m / TILE, n / BLOCK_SHINGLES)).cast("int")
    tiled = mixed_regions(left)
    tiled = tiled.select("tree", "region", "part", (-F.col("most.main")).alias("main"), pieces(F.col("m"), F.col("n")).alias("wide"), pieces(F.col("m") - F.col("most.m"), F.col("n") - F.col("most.of")).alias("high"))
    here = left.join(tiled, ["tree", "region", "part"])
    place = F.xxhash64(F.col("h"), F.lit(1))
    all_tiles = here.withColumns({"x": F.pmod(place, "wide").cast("int"), "y": F.explode(F.expr("sequence(0, high - 1)")), "asks": F.lit(False)})
    asked = here.where("comp <> main").withColumns({"y": F.pmod(place, "high").cast("int"), "x": F.explode(F.expr("sequence(0, wide - 1)")), "asks": F.lit(True)})
    return all_tiles.unionByName(asked).select("tree", F.xxhash64("region", "x", "y").alias("block"), "rep", "comp", "asks")


def compared(reps: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a block that connect what wasn't connected: (pivot, other). Every two documents left unconnected have been compared.

    With ``asks`` only the documents it marks are pivots.
    """
    group: dict[int, int] = {}
    label = np.array([group.setdefault(c, len(group)) for c in comps.tolist()])
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, place, common = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    centre = np.add.reduceat(common[place], starts) / sizes  # documents whose shingles many others share come first
    mark = np.zeros(len(common), np.int64)
    links: list[tuple[int, int]] = []
    order = np.argsort(-centre, kind="stable")
    for p in (order if asks is None else order[asks[order]]).tolist():
        if (label == label[p]).all():
            if (label == label[0]).all():
                break
            continue
        own = place[starts[p] : starts[p] + sizes[p]]
        mark[own] = 1
        both = np.add.reduceat(mark[place], starts)
        mark[own] = 0
        near = 100 * both >= percent * (sizes + sizes[p] - both)
        for q in np.flatnonzero(near).tolist():
            if label[q] != label[p]:
                links.append((int(reps[p]), int(reps[q])))
                label[label == label[q]] = label[p]
    return links


def links_of(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) of links found in the blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("rep")))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("set")]
        asks = table.column("asks").to_numpy() if "asks" in table.column_names else None
        found = compared(table.column("rep").to_numpy(), table.column("comp").to_numpy(), sets, percent, asks)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.join(sets, "rep").groupBy("tree", "block").applyInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, space: Workspace, most_rounds: int = 60) -> DataFrame:
    """Rows (rep, comp): the smallest id that each linked id reaches.

    Alternating large and small stars: each round points every id to the smallest neighbour of its neighbours, until all point to the
    smallest of all. Rounds are written, so no lineage grows; keys are ids, and the smallest neighbour is found with a partial aggregate.
    """
    edges = space.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > c").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(root, F.col("u") == F.col("c"))
        new = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, edges = edges, space.table(new, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        space.drop(before)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("rep")).distinct().select("rep", F.col("rep").alias("comp"))
    return edges.select(F.col("u").alias("rep"), F.col("v").alias("comp")).unionByName(roots)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = NEAR_PERCENT, space: Workspace | None = None) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``."""
    spark = docs.sparkSession
    space = space or Workspace(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    every = space.table(signed(texts, words), "signed")
    classes = every.where("digest is not null and doc_id is not null")
    reps = space.table(classes.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "reps")

    near = space.table(region_rows(tree_rows(reps), TREES * reps.count()), "regions")
    n_near = near.count()
    involved = near.select("rep").distinct().withColumnRenamed("rep", "doc_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch.column(1), cache, words)], pa.binary())], ["rep", "set"])
        cache.clear()
        freed()

    # Rows that repeat an id are one document to the links: a link of any of them counts for the id.
    wanted = texts.join(involved.hint("shuffle_hash"), "doc_id", "left_semi")
    built = wanted.mapInArrow(build, "rep long, set binary")
    sets = space.table(built.where(F.length("set") > 0), "sets")

    first = near.where(F.col("tree") < FIRST).select("*", F.col("rep").alias("comp"), F.lit(0).cast("long").alias("deg"))
    found = space.table(links_of(block_rows(first, n_near), sets, percent), "links")
    known = space.table(components(found, space), "components")
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("deg"))
    again = near.join(known, "rep", "left").join(degree, "rep", "left").select("tree", "key", "rep", "n", F.coalesce("comp", "rep").alias("comp"), F.coalesce("deg", F.lit(0)).alias("deg"))
    more = links_of(block_rows(again, n_near), sets, percent)
    all_links = space.table(found.unionByName(more).unionByName(known.where("rep <> comp").select(F.col("rep").alias("a"), F.col("comp").alias("b"))), "links")
    final = space.table(components(all_links, space), "components")
    placed = near.join(final, "rep", "left").select("tree", "key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    rest = space.table(links_of(remaining(placed, sets, percent, space), sets, percent), "links")
    if not rest.isEmpty():
        joined = final.where("rep <> comp").select(F.col("rep").alias("a"), F.col("comp").alias("b"))
        final = space.table(components(joined.unionByName(rest), space), "components")

    named = reps.select("digest", "rep").join(final, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
    linked = classes.join(named, "digest").select("doc_id", "n_shingles", "component_id")
    alone = every.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
