"""Graph operators: reachability, shortest proofs, closures, strong components.

All are fixpoints of joins. A round follows several steps from what the last one found, in one job, and is written with its count; what
was found before is a few tables that are put together now and then. So neither plans nor the files read grow with the rounds. Tables that grow
with the graph are shuffled and never broadcast, as each round would send them to the driver again. Ids may be of any type. Edges may hold parallel
edges and loops.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.chains import chain_ends
from graphloom.operators.tables import Rounds, shuffled

#: Steps that a round follows, and from few rows, where a round's own cost counts most; tables of what was found that are put together.
STEPS, STEPS_OF_FEW, FEW_ROWS, PARTS = 4, 3, 100_000, 4
#: Most nodes for which components are found through all pairs, 64 of them to a row.
FEW_NODES = 4096
#: About as many nodes of a run are held by a row when its pairs are told.
BLOCK = 512


def _stride(rows: int) -> int:
    return STEPS if rows > FEW_ROWS else STEPS_OF_FEW


def fixpoint(rounds: Rounds, start: DataFrame, step: Callable[[DataFrame, Column, Column], DataFrame], keys: list[str], *, extra: str | None = None, max_hops: int | None = None) -> DataFrame:
    """``start`` and all that ``step`` makes of it, each row of ``keys`` once, with ``hop``, the steps that it takes.

    ``step`` gets rows of ``keys`` (and the column ``extra``, of which the least is kept among those of fewest steps) and ``hop``, the condition of
    the rows to go on from, and the next hop. It returns all the rows and what comes of those, so that steps follow each other in one plan.
    """
    names = [*keys, *([extra] if extra else [])]
    value = F.struct("hop", *([extra] if extra else []))
    least = lambda rows: rows.groupBy(*keys).agg(F.min(value).alias("__v")).select(*keys, "__v.*")
    front, n = rounds.counted(least(start.select(*names).withColumn("hop", F.lit(0))))
    seen, hop = [front], 0
    while n and (max_hops is None or hop < max_hops):
        end = hop + _stride(n) if max_hops is None else min(hop + _stride(n), max_hops)
        ahead = front
        for k in range(hop, end):
            ahead = least(step(ahead, F.col("hop") == k, F.lit(k + 1)).select(*names, "hop"))
        old = shuffled(reduce(DataFrame.unionByName, seen).select(*[F.col(c).alias(f"__{c}") for c in keys]))
        new = ahead.where(F.col("hop") > hop).join(old, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left_anti")
        hop = end
        # What took fewer steps than this round's has been followed in it already.
        table, n = rounds.counted(new, F.col("hop") == hop)
        front = table.where(F.col("hop") == hop)
        seen.append(table)
        if len(seen) > PARTS:
            merged = rounds.table(reduce(DataFrame.unionByName, seen))
            front = merged.where(F.col("hop") == hop)
            rounds.drop(*seen)
            seen = [merged]
    return reduce(DataFrame.unionByName, seen)


def _followed(edge: DataFrame, rows: DataFrame, now: Column, **following: Column) -> DataFrame:
    """``rows`` and those behind an edge from the rows for which ``now`` holds; ``following`` tells what changes in these."""
    met = rows.join(shuffled(edge), (F.col("node") == F.col("__src")) & now, "left")
    behind = F.when(F.col("__dst").isNotNull(), F.struct(*[following.get(c, F.col(c)).alias(c) for c in rows.columns]))
    return met.select(F.explode(F.array_compact(F.array(F.struct(*rows.columns), behind))).alias("__e")).select("__e.*")


def _steps(rounds: Rounds, edges: DataFrame) -> DataFrame:
    return rounds.table(edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst")).distinct())


def reach(edges: DataFrame, seeds: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """``seeds`` has ``node`` and any label columns; returns (labels, node, hop) of what each label's seeds reach, the seeds at hop 0.

    One row per label and node: for many labels over one graph see ``reach_sets``.
    """
    rounds = Rounds(edges.sparkSession)
    labels = [c for c in seeds.columns if c != "node"]
    edge = _steps(rounds, edges)
    step = lambda rows, now, then: _followed(edge, rows, now, node=F.col("__dst"), hop=then)
    return fixpoint(rounds, seeds, step, [*labels, "node"], max_hops=max_hops).select(*labels, "node", "hop")


def reach_sets(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(label, node) of what each label's seeds (label, node) reach, the seeds included.

    A node holds the labels that reach it as bits, 64 to a row, so a round moves a 64th of the pairs, and or-ing them is a partial aggregate.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark)
    edge = _steps(rounds, edges)
    number = F.monotonically_increasing_id()
    labels = rounds.table(seeds.select("label").distinct().select("label", number.alias("k")))
    low = F.col("k").bitwiseAND((1 << 33) - 1)
    labels = labels.select("label", (F.shiftright("k", 33) * (1 << 27) + F.shiftright(low, 6)).alias("word"), low.bitwiseAND(63).cast("int").alias("bit"))
    own = seeds.distinct().join(labels.withColumnRenamed("label", "__l"), F.col("label").eqNullSafe(F.col("__l")))  # labels may be few: large ones alone are shuffled
    own = own.groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    state, n = rounds.counted(own.withColumn("fresh", F.col("bits")))
    while n:
        ahead = state.where("fresh <> 0").select("node", "word", "fresh")
        for _ in range(_stride(n)):
            ahead = _followed(edge, ahead, F.lit(True), node=F.col("__dst")).groupBy("node", "word").agg(F.bit_or("fresh").alias("fresh"))
        both = state.drop("fresh").join(shuffled(ahead.withColumnRenamed("fresh", "found")), ["node", "word"], "full_outer").select("node", "word", F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce("found", F.lit(0)).alias("found"))
        last = state
        state, n = rounds.counted(both.select("node", "word", F.expr("bits | found").alias("bits"), F.expr("found & ~bits").alias("fresh")), F.col("fresh") != 0)
        rounds.drop(last)
    bits = state.select("node", "word", F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)")).alias("bit"))
    return bits.join(labels, ["word", "bit"]).select("label", "node")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def shortest_proofs(edges: DataFrame, seeds: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """(node, hop, path): a shortest path from any seed, of several the least by its nodes in order."""
    rounds = Rounds(edges.sparkSession)
    edge = _steps(rounds, edges)
    step = lambda rows, now, then: _followed(edge, rows, now, node=F.col("__dst"), path=F.concat("path", F.array("__dst")), hop=then)
    start = seeds.select("node").distinct().withColumn("path", F.array("node"))
    return fixpoint(rounds, start, step, ["node"], extra="path", max_hops=max_hops).select("node", "hop", "path")


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, run, place, ring) of the nodes of ``edges``, and (src, dst) between runs; loops and edges without an end don't count.

    A run is a line of nodes of which each leads to the next only, and only it leads there. It is named by its first node; all other edges go from last
    nodes to first ones. What goes round without other edges is a ring, named by its least node. A search over runs takes no rounds for the steps inside.
    """
    rounds = Rounds(edges.sparkSession)
    edge = rounds.table(edges.select("src", "dst").where("src <> dst").distinct())
    alone = lambda end, other: edge.groupBy(end).agg(F.min(other).alias(other), F.count("*").alias("__n")).where("__n = 1").select("src", "dst")
    inner = rounds.table(alone("src", "dst").join(shuffled(alone("dst", "src")), ["src", "dst"]))
    firsts = chain_ends(inner.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    nodes = edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct()
    members = rounds.table(nodes.join(shuffled(firsts), "node", "left").select("node", F.coalesce("end", "node").alias("run"), F.coalesce("hops", F.lit(0)).alias("place"), F.coalesce("cyclic", F.lit(False)).alias("ring")))
    a, b = members.select(F.col("node").alias("__a"), F.col("run").alias("__ra")), members.select(F.col("node").alias("__b"), F.col("run").alias("__rb"))
    outer = edge.join(shuffled(inner), ["src", "dst"], "left_anti").join(shuffled(a), F.col("src") == F.col("__a")).join(shuffled(b), F.col("dst") == F.col("__b"))
    return members, rounds.table(outer.select(F.col("__ra").alias("src"), F.col("__rb").alias("dst")).distinct())


def closure(edges: DataFrame) -> DataFrame:
    """All (a, b) with a path of one edge or more from a to b; edges without an end are none.

    Runs of nodes are searched as one node. Their pairs are told at last, block of nodes by block, so no row or task holds a run or a component as a whole.
    """
    rounds = Rounds(edges.sparkSession)
    members, links = contracted(edges)
    sizes = members.groupBy("run").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), (F.count("*") > 1).alias("several"), F.bool_or("ring").alias("ring"))
    # A run's number of blocks goes with its name through the search.
    named = rounds.table(sizes.select(F.struct("run", "blocks").alias("id"), "several", "ring"))
    blocks = members.join(shuffled(named.select("id.run", "id.blocks")), "run").groupBy("run", F.expr("pmod(xxhash64(node), blocks)").alias("block")).agg(F.collect_list(F.struct("node", "place")).alias("nodes"))
    blocks = rounds.table(blocks)
    ids = named.select(F.col("id.run").alias("__run"), "id")
    over = links.join(shuffled(ids.toDF("__s", "a")), F.col("src") == F.col("__s")).join(shuffled(ids.toDF("__d", "b")), F.col("dst") == F.col("__d")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    over = rounds.table(over)
    pairs = reach_sets(over, over.select(F.col("src").alias("label"), F.col("dst").alias("node"))).select(F.col("label").alias("a"), F.col("node").alias("b"))
    round_ = rounds.table(pairs.where("a = b").select("a"))
    inside = named.where("several").join(shuffled(round_), F.col("id") == F.col("a"), "left_anti").select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("ring").alias("every"))
    every = pairs.withColumn("every", F.lit(True)).unionByName(inside)
    number = lambda end: F.explode(F.sequence(F.lit(0), F.col(f"{end}.blocks") - 1))
    asked = every.withColumn("ka", number("a")).withColumn("kb", number("b")).select(F.col("a.run").alias("ra"), "ka", F.col("b.run").alias("rb"), "kb", "every")
    met = asked.join(shuffled(blocks.toDF("ra", "ka", "as")), ["ra", "ka"]).join(shuffled(blocks.toDF("rb", "kb", "bs")), ["rb", "kb"])
    told = met.select("every", "bs", F.explode("as").alias("a")).select("every", "a", F.explode("bs").alias("b")).where("every or a.place < b.place").select("a.node", "b.node").toDF("a", "b")
    circling = round_.select("a.run").unionByName(named.where("ring").select("id.run"))
    loops = edges.where("src = dst").select(F.col("src").alias("a")).distinct().join(shuffled(members.join(shuffled(circling), "run").select(F.col("node").alias("a"))), "a", "left_anti")
    return told.unionByName(loops.select("a", F.col("a").alias("b")))


def trimmed(edges: DataFrame, *, times: int = 4) -> DataFrame:
    """Edges without many of those that can't lie on a cycle: ends without edges in or out are cut, so often at most."""
    rounds = Rounds(edges.sparkSession)
    left, size = rounds.counted(edges.select("src", "dst").where("src <> dst").distinct())
    for _ in range(times):
        ins, outs = left.select(F.col("dst").alias("__in")).distinct(), left.select(F.col("src").alias("__out")).distinct()
        last, before = left, size
        left, size = rounds.counted(left.join(shuffled(ins), F.col("src") == F.col("__in"), "left_semi").join(shuffled(outs), F.col("dst") == F.col("__out"), "left_semi"))
        rounds.drop(last)
        if size in (0, before):
            break
    return left


def least_labels(rounds: Rounds, edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each node of ``edges`` (itself included)."""
    edge = _steps(rounds, edges)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state, n = rounds.counted(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")))
    while n:
        ahead = state.where("fresh").select("node", "colour")
        for _ in range(_stride(n)):
            ahead = _followed(edge, ahead, F.lit(True), node=F.col("__dst")).groupBy("node").agg(F.min("colour").alias("colour"))
        both = state.drop("fresh").join(shuffled(ahead.withColumnRenamed("colour", "less")), "node", "left")
        last = state
        state, n = rounds.counted(both.select("node", F.least("colour", "less").alias("colour"), F.coalesce(F.col("less") < F.col("colour"), F.lit(False)).alias("fresh")), F.col("fresh"))
        rounds.drop(last)
    return state.select("node", "colour")


def strong_components(edges: DataFrame, *, few: int = FEW_NODES) -> DataFrame:
    """(node, component): nodes on cycles of two nodes or more, named by their component's least node.

    Runs of nodes are taken as one node first (``contracted``).
    """
    members, links = contracted(edges)
    rounds = Rounds(edges.sparkSession)
    several = rounds.table(_components(rounds, links.where("src <> dst"), few).select(F.col("node").alias("run"), "component"))
    # Runs that lead back to themselves and to no others.
    alone = links.where("src = dst").select(F.col("src").alias("run")).unionByName(members.where("ring").select("run").distinct()).join(shuffled(several), "run", "left_anti")
    found = members.select("node", "run").join(shuffled(several.unionByName(alone.select("run", F.col("run").alias("component")))), "run").select("node", F.col("component").alias("__c"))
    least = found.groupBy("__c").agg(F.min("node").alias("component"))
    return found.join(shuffled(least), "__c").select("node", "component")


def _components(rounds: Rounds, plain: DataFrame, few: int) -> DataFrame:
    """(node, component) of a graph without loops and parallel edges.

    Of few nodes, those that reach each other are paired. Otherwise nodes are coloured by the least node that reaches them: a colour's
    component is what reaches that node within the colour. Components found are taken out, and the rest is trimmed and coloured again.
    """
    if plain.select("src").distinct().count() <= few:
        pairs = rounds.table(reach_sets(plain, plain.select(F.col("src").alias("label"), F.col("dst").alias("node"))).toDF("a", "b"))
        mutual = pairs.join(shuffled(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"])
        return mutual.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    left = trimmed(plain)
    done = rounds.table(left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0))
    while not left.isEmpty():
        colours = least_labels(rounds, left)
        a, b = colours.toDF("__a", "__ca"), colours.toDF("__b", "__cb")
        inside = left.join(shuffled(a), F.col("src") == F.col("__a")).join(shuffled(b), F.col("dst") == F.col("__b")).where("__ca = __cb").select("src", "dst")
        roots = colours.where("node = colour").select("node")
        back = reach(reversed_edges(inside), roots).select("node")
        found = rounds.table(back.join(shuffled(colours), "node").select("node", F.col("colour").alias("component")))
        several = found.groupBy("component").count().where("count > 1").select("component")
        done = rounds.table(done.unionByName(found.join(shuffled(several), "component", "left_semi").select("node", "component")))
        gone = found.select(F.col("node").alias("__g"))
        rest = left.join(shuffled(gone), F.col("src") == F.col("__g"), "left_anti").join(shuffled(gone), F.col("dst") == F.col("__g"), "left_anti")
        left = trimmed(rest)
    return done


def cycle_chains(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, length, chain): a shortest cycle through each component's least node, of several the least by its nodes."""
    rounds = Rounds(edges.sparkSession)
    inside = components.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    steps = edges.select("src", "dst").where("src <> dst").distinct().join(shuffled(inside), F.col("src") == F.col("__n")).select("src", "dst", F.col("__c").alias("c"))
    steps = rounds.table(steps.join(shuffled(inside.toDF("n2", "c2")), (F.col("dst") == F.col("n2")) & (F.col("c") == F.col("c2"))).select("src", "dst", "c").toDF("__src", "__dst", "__c"))
    front, n = rounds.counted(components.select("component").distinct().select("component", F.col("component").alias("node"), F.array("component").alias("chain")))
    seen = front.select("component", "node")
    done = rounds.table(front.select("component", F.size("chain").alias("length"), "chain").limit(0))
    while n:
        found = front.join(shuffled(steps), (F.col("node") == F.col("__src")) & (F.col("component") == F.col("__c"))).select("component", F.col("__dst").alias("node"), F.concat("chain", F.array("__dst")).alias("chain"))
        best = rounds.table(found.groupBy("component", "node").agg(F.min("chain").alias("chain")))
        closed = best.where("node = component").select("component", F.size("chain").alias("length"), "chain")
        done = rounds.table(done.unionByName(closed.join(shuffled(done.select(F.col("component").alias("__d"))), F.col("component") == F.col("__d"), "left_anti")))
        fresh = best.join(shuffled(done.select(F.col("component").alias("__d"))), F.col("component") == F.col("__d"), "left_anti").join(shuffled(seen.toDF("__c", "__n")), (F.col("component") == F.col("__c")) & (F.col("node") == F.col("__n")), "left_anti")
        front, n = rounds.counted(fresh)
        seen = seen.unionByName(front.select("component", "node"))
    return done
