"""Parent-child links to full hierarchies, by bottom-up leaf peeling.

A round splits the nodes that are left into id ranges of bounded size, and each range peels its leaves for as long as it can: a node
goes once all its children are gone, and hands its subtree size to its parent. The nodes that a range peels under one top form a
fragment. Where ids follow the tree few rounds are needed. Where they don't, a range gets few nodes of a chain at a time; so if a round
takes less than a quarter of the nodes, the stretches of nodes with one child are contracted, each to one link that remembers its
length, its nodes' sizes and the rest. Their places in the stretch are found by pointer doubling, in as many steps as their length has
binary digits. After that at least half of the nodes are leaves, so the number of rounds grows with the logarithm of the nodes, whatever
the depth and the ids. What can be neither peeled nor contracted in the end are exactly the nodes on cycles (and cycles contracted to
fewer of their nodes). The reverse order of the rounds hands sizes to the contracted nodes, and root, depth and path to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import Workspace, shuffle_partitions

#: Nodes that one task peels at most (about 100 bytes each), and from which on peeling is spread over several.
RANGE_NODES = 250_000
SPREAD_NODES = 20_000
#: Elements of path in one Arrow batch.
PATH_BATCH = 500_000
#: Nodes of one part of a stretch.
STRETCH_PART = 50_000


def _peel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Peel one range. kids: children not yet gone, in any range; size: nodes below that are gone already, and the node itself; extra and
    deep: nodes hanging on the link to the parent and the links that it stands for."""
    ids, parent = pdf["id"].to_numpy(), pdf["parent"]
    order = np.argsort(ids)
    n, place = len(ids), ids[order]
    has = parent.notna().to_numpy()
    want = parent.fillna(0).to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(place, want), n - 1)
    up = np.where(has & (place[at] == want), order[at], -1).tolist()
    kids, size, extra, deep = (pdf[c].tolist() for c in ("kids", "size", "extra", "deep"))
    stack, gone = [k for k in range(n) if kids[k] == 0], []
    while stack:
        k = stack.pop()
        gone.append(k)
        if (p := up[k]) >= 0:
            size[p] += size[k] + extra[k]
            kids[p] -= 1
            if kids[p] == 0:
                stack.append(p)
    top, hops = [-1] * n, [0] * n
    for k in reversed(gone):  # parents come before their children
        p = up[k]
        if p >= 0 and top[p] >= 0:
            top[k], hops[k] = top[p], hops[p] + deep[k]
        else:
            top[k] = k
    top = np.asarray(top)
    out = pdf[["id", "orig", "extra", "deep"]].assign(parent=parent.astype("Int64"), via=pdf["via"].astype("Int64"), kids=kids, size=size)
    out["orig"] = pdf["orig"].astype("Int64")
    return out.assign(top=np.where(top >= 0, ids[top], 0), hops=hops, gone=top >= 0, passed=np.asarray(up) >= 0)[[c.split()[0] for c in NODE.split(", ")]]


#: parent: as contracted so far; orig: as given; via: the stretch that the link to the parent stands for.
STATE = ["id", "parent", "orig", "kids", "size", "extra", "deep", "via"]
NODE = "id long, parent long, orig long, kids long, size long, extra long, deep long, via long, top long, hops long, gone boolean, passed boolean"


def _peel_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition holds one range, of at most about twice RANGE_NODES."""
    if parts := [b for b in batches if len(b)]:
        yield _peel(pd.concat(parts, ignore_index=True))


def _contract(left: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame, int]:
    """Contract the stretches of nodes with one child: the nodes left, those contracted, and their number.

    A contracted node has its stretch (named by its top node), the links from the stretch's anchor (the first node above it) down to it,
    the anchor, the node below the stretch (under), and that one's link before. On a cycle without other nodes there is no top, so
    nothing of it is contracted.
    """
    one = left.where("kids = 1 AND parent IS NOT NULL AND parent <> id")
    one = ws.keep(one, "one")
    tops = one.select("id").withColumnRenamed("id", "parent").withColumn("inner", F.lit(True))
    state = one.join(tops, "parent", "left").select("id", F.when(F.col("inner"), F.col("parent")).otherwise(F.col("id")).alias("at"), F.when(F.col("inner"), F.col("deep")).otherwise(0).alias("d"), F.col("inner").isNull().alias("done"))
    state = ws.keep(state, "places")
    total, done = state.agg(F.count("*"), F.count_if("done")).first()
    while 0 < done < total:
        ahead = state.selectExpr("id AS at", "at AS further", "d AS more", "done AS ends")
        moved = state.where("NOT done").join(ahead, "at").selectExpr("id", "further AS at", "d + more AS d", "ends AS done")
        newer = ws.keep(state.where("done").unionByName(moved), "places")
        ws.drop(state)
        state, before = newer, done
        done = state.where("done").count()
        if done == before:  # the end of a stretch comes nearer in every step: what is left goes round a cycle
            break
    placed = state.where("done").selectExpr("id", "at AS stretch", "d")
    nodes = one.join(placed, "id")
    top = nodes.where("id = stretch").selectExpr("stretch", "parent AS anchor", "deep AS first")
    # the node below a stretch is the one child of a contracted node that isn't contracted itself
    under = left.join(placed.select(F.col("id").alias("parent"), "stretch"), "parent").join(placed.select("id"), "id", "left_anti")
    under = under.selectExpr("stretch", "id AS under", "extra AS under_extra", "via AS under_via")
    spliced = ws.keep(nodes.join(top, "stretch").join(under, "stretch").withColumn("links", F.col("d") + F.col("first")).drop("d", "first"), "spliced")
    ends = spliced.groupBy("under").agg(F.first("anchor").alias("anchor"), F.first("stretch").alias("stretch"), F.sum(F.col("size") + F.col("extra")).alias("more"), F.sum("deep").alias("links")).withColumnRenamed("under", "id")
    rest = left.join(spliced.select("id"), "id", "left_anti").join(ends, "id", "left")
    rest = rest.select(
        "id",
        F.coalesce("anchor", "parent").alias("parent"),
        "orig",
        "kids",
        "size",
        (F.col("extra") + F.coalesce("more", F.lit(0))).alias("extra"),
        (F.col("deep") + F.coalesce("links", F.lit(0))).alias("deep"),
        F.coalesce("stretch", "via").alias("via"),
    )
    rest = ws.keep(rest, "left")
    ws.drop(state, one)
    return rest, spliced, done


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over a stretch's nodes from its top down to each; long stretches are cut into parts, which are added up first."""
    cut = rows.withColumn("__part", F.floor(F.col("links") / STRETCH_PART))
    across = Window.partitionBy("stretch").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("stretch", "__part").agg(F.sum(value).alias("__t")).select("stretch", "__part", F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__base"))
    within = Window.partitionBy("stretch", "__part").orderBy("links").rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(base, ["stretch", "__part"]).withColumn(name, F.sum(value).over(within) + F.col("__base")).drop("__part", "__base")


def _cycle_least(ring: DataFrame, ws: Workspace) -> DataFrame:
    """(id, root_id, loop_at): the least id on each node's cycle and the steps to it, by doubling: after round r a node knows the least of 2**r ids from itself on."""
    state = ws.keep(ring.select("id", F.col("parent").alias("next"), F.least("id", "parent").alias("low"), (F.col("parent") < F.col("id")).cast("long").alias("steps")), "ring")
    hop = 1
    while True:
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("low").alias("theirs"), (F.col("steps") + hop).alias("their_steps"))
        moved = F.col("theirs") < F.col("low")
        steps = F.when(moved, F.col("their_steps")).otherwise(F.col("steps")).alias("steps")
        newer = ws.keep(state.join(ahead, "next").select("id", F.col("further").alias("next"), F.least("low", "theirs").alias("low"), steps, moved.alias("moved")), "ring")
        ws.drop(state)
        if newer.where("moved").isEmpty():
            return newer.select("id", F.col("low").alias("root_id"), F.col("steps").alias("loop_at"))
        hop *= 2
        state = newer.drop("moved")
        state._loom_path = newer._loom_path


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How far a node comes behind its fragment's top in pre-order; a partition holds whole fragments."""
    if not (parts := [b for b in batches if len(b)]):
        return
    rows = pd.concat(parts, ignore_index=True).sort_values("hops")
    rel: dict[int, int] = {}
    for i, p, h, step in zip(*(rows[c].tolist() for c in ("id", "parent", "hops", "step"))):
        rel[i] = rel[int(p)] + step if h else 0
    yield pd.DataFrame({"id": list(rel), "rel": list(rel.values())})


def _before(nodes: DataFrame) -> DataFrame:
    """(id, before): the nodes in the subtrees of a node's earlier siblings. Siblings are cut into id ranges, so many under one parent are no single task's."""
    spans = nodes.agg(F.min("id"), F.max("id")).first()
    lo, hi = spans[0] or 0, spans[1] or 0
    part = F.least(F.greatest(F.floor((F.col("id") - lo) * F.lit(1000) / max(1, hi - lo)), F.lit(0)), F.lit(999)).cast("int")
    cut = nodes.select("id", "parent", "size", part.alias("part"))
    within = Window.partitionBy("parent", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("parent", "part").agg(F.sum("size").alias("t")).select("parent", "part", F.coalesce(F.sum("t").over(across), F.lit(0)).alias("base"))
    return cut.withColumn("b", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["parent", "part"]).select("id", (F.col("b") + F.col("base")).alias("before"))


def hierarchy(df: DataFrame, id: str = "id", parent: str = "parent", *, range_nodes: int = RANGE_NODES, log: list[int] | None = None) -> DataFrame:
    """One row for each distinct id: id, parent, root_id, depth, size, pre, last, cyclic, loop_id, loop_at.

    A parent that is null, 0 or no id of the table means none. depth is 0 for a root; size counts the node and all its descendants; pre
    is the node's place in the pre-order of its tree (root 0, siblings by id) and last that of its last descendant. So a node's
    descendants are the rows of its root with pre < theirs <= last, and its path are the rows of its root whose pre to last holds its own
    pre: whole results in linear size, while written out they grow with the square of the depth. :func:`paths` and :func:`descendants`
    write them out.

    A node that never reaches a root (on a cycle, or below one) is cyclic: its root_id is the least id on that cycle and its depth is null.
    loop_id is the first node on the cycle above it (itself if it is on the cycle), and pre and last are places in the tree that hangs below
    loop_id, so its descendants off the cycle are the rows of its loop_id. loop_at, set on the cycle only, is the number of steps over parents
    to root_id; size counts the rest of the cycle, and what hangs below it, among a cycle node's descendants. Rows with a null id are left out. Of rows that repeat an id the least usable parent counts. An
    empty table gives no rows; other columns are ignored. ``log`` receives the number of nodes left at the start of every round.
    """
    spark = df.sparkSession
    ws = Workspace(spark)
    p = F.col(f"`{parent}`").cast("long")
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.when(p != 0, p).alias("parent")).where("id IS NOT NULL")
    ids = rows.select(F.col("id").alias("parent"), F.lit(True).alias("real")).distinct()
    known = rows.join(ids, "parent", "left").groupBy("id").agg(F.min(F.when(F.col("real"), F.col("parent"))).alias("parent"))
    known = ws.keep(known, "nodes")
    kids = known.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    nothing = F.lit(None).cast("long")
    left = known.join(kids, "id", "left").select("id", "parent", F.col("parent").alias("orig"), F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("extra"), F.lit(1).cast("long").alias("deep"), nothing.alias("via"))
    left = ws.keep(left, "left")
    ws.drop(known)
    rounds: list[tuple[str, DataFrame]] = []
    n = left.count()
    while n:
        if log is not None:
            log.append(n)
        ranges = max(-(-n // range_nodes), min(shuffle_partitions(spark), -(-n // min(range_nodes, SPREAD_NODES))))
        split = left.repartitionByRange(ranges, "id") if ranges > 1 else left.coalesce(1)
        peeled = ws.keep(split.mapInPandas(_peel_ranges, NODE), "peeled")
        gone = peeled.where("gone")
        rounds.append(("peeled", gone))
        # a range passed on sizes within itself; what hangs below nodes of other ranges is passed on here
        tops = gone.where("hops = 0 AND parent IS NOT NULL AND NOT passed")
        across = tops.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("fewer"), F.sum(F.col("size") + F.col("extra")).alias("more"))
        stay = peeled.where("NOT gone").join(across, "id", "left")
        fewer = stay.withColumn("kids", F.col("kids") - F.coalesce("fewer", F.lit(0))).withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).select(STATE)
        fewer = ws.keep(fewer, "left")
        ws.drop(left)
        left, before = fewer, n
        n = left.count()
        if n and 4 * (before - n) < before:
            rest, spliced, some = _contract(left, ws)
            if some:
                ws.drop(left)
                left = rest
                rounds.append(("spliced", spliced))
                n -= some
            elif n == before:
                break
    # sizes, in reverse order: a contracted node has all nodes of its stretch from itself on and those below it
    sized: list[DataFrame] = []
    cycles = [left.select("id", "orig", F.col("size").alias("span"))]
    later = left.select("id", "size", F.lit(True).alias("ring"))
    splices: dict[int, DataFrame] = {}
    for k in reversed(range(len(rounds))):
        kind, nodes = rounds[k]
        if kind == "peeled":
            own = nodes.select("id", "orig", "size")
            later = later.unionByName(own.select("id", "size", F.lit(False).alias("ring")))
        else:
            below = later.select(F.col("id").alias("under"), F.col("size").alias("under_size"), "ring")
            full = _running(nodes.withColumn("held", F.col("size") + F.col("extra")), "held", "so_far")
            whole = nodes.groupBy("stretch").agg(F.sum(F.col("size") + F.col("extra")).alias("all"))
            full = full.join(whole, "stretch").join(below, "under")
            size = F.col("under_size") + F.col("under_extra") + F.col("all") - F.col("so_far") + F.col("size")
            full = ws.keep(full.withColumn("full", size).select(*nodes.columns, "full", "ring"), "sized")
            cycles.append(full.where("ring").select("id", "orig", F.col("size").alias("span")))
            splices[k] = full.where("NOT ring")
            own = splices[k].select("id", "orig", F.col("full").alias("size"))
            later = later.unionByName(full.select("id", F.col("full").alias("size"), "ring"))
        sized.append(own)
    done = spark.createDataFrame([], "id long, parent long, root_id long, depth long, size long, pre long, cyclic boolean, span long, loop_id long, loop_at long")
    if n:
        ring = ws.keep(reduce(DataFrame.unionByName, cycles).withColumnRenamed("orig", "parent"), "ring")
        ring = ring.join(_cycle_least(ring, ws), "id")
        ring = ring.join(ring.groupBy("root_id").agg(F.sum("span").alias("size")), "root_id")
        pre = F.lit(0).cast("long").alias("pre")
        done = ring.select("id", "parent", "root_id", nothing.alias("depth"), "size", pre, F.lit(True).alias("cyclic"), "span", F.col("id").alias("loop_id"), "loop_at")
    if not rounds:
        return done.select("id", "parent", "root_id", "depth", "size", "pre", (F.col("pre") + F.col("span") - 1).alias("last"), "cyclic", "loop_id", "loop_at")
    # step: how far a node comes behind its parent in pre-order; over a contracted link, behind the node at its upper end
    steps = _before(reduce(DataFrame.unionByName, sized).where("orig IS NOT NULL").withColumnRenamed("orig", "parent"))
    steps = ws.keep(steps.select("id", (F.col("before") + 1).alias("step")), "steps")
    over = None
    for k in sorted(splices):
        nodes = splices[k].join(steps, "id")
        if over is not None:
            nodes = nodes.join(over.selectExpr("stretch AS via", "total AS had"), "via", "left").withColumn("step", F.col("step") + F.coalesce("had", F.lit(0))).drop("had")
        splices[k] = ws.keep(_running(nodes, "step", "behind"), "behind")
        total = splices[k].groupBy("stretch", "under_via").agg(F.sum("step").alias("total"))
        if over is not None:
            total = total.join(over.selectExpr("stretch AS under_via", "total AS had"), "under_via", "left").select("stretch", (F.col("total") + F.coalesce("had", F.lit(0))).alias("total"))
        over = total.select("stretch", "total") if over is None else over.unionByName(total.select("stretch", "total"))
        over = ws.keep(over, "over")
    for k in reversed(range(len(rounds))):
        kind, nodes = rounds[k]
        above = done.select(F.col("id").alias("above"), "root_id", "depth", F.col("pre").alias("over"), "cyclic", "loop_id")
        if kind == "spliced":
            inner = splices[k].join(above, F.col("anchor") == F.col("above"))
            inner = inner.select("id", F.col("orig").alias("parent"), "root_id", (F.col("depth") + F.col("links")).alias("depth"), F.col("full").alias("size"), (F.col("over") + F.col("behind")).alias("pre"), "cyclic", F.col("full").alias("span"), "loop_id", nothing.alias("loop_at"))
        else:
            gone = nodes.join(steps, "id", "left").withColumn("step", F.coalesce("step", F.lit(0)))
            if over is not None:
                gone = gone.join(over.selectExpr("stretch AS via", "total AS had"), "via", "left").withColumn("step", F.col("step") + F.coalesce("had", F.lit(0)))
            gone = ws.keep(gone.select("id", "parent", "orig", "size", "deep", "top", "hops", "step"), "gone")
            rel = gone.repartition("top").mapInPandas(_offsets, "id long, rel long")
            new = F.col("above").isNull()
            tops = gone.where("hops = 0").select("top", "step", "deep", F.col("parent").alias("above")).join(above, "above", "left")
            tops = tops.select(
                "top",
                F.when(new, F.col("top")).otherwise(F.col("root_id")).alias("root_id"),
                F.when(new, 0).otherwise(F.col("depth") + F.col("deep")).alias("from_depth"),
                F.when(new, 0).otherwise(F.col("over") + F.col("step")).alias("from_pre"),
                F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
                "loop_id",
            )
            inner = gone.join(rel, "id").join(tops, "top")
            inner = inner.select("id", F.col("orig").alias("parent"), "root_id", (F.col("from_depth") + F.col("hops")).alias("depth"), "size", (F.col("from_pre") + F.col("rel")).alias("pre"), "cyclic", F.col("size").alias("span"), "loop_id", nothing.alias("loop_at"))
        newer = ws.keep(done.unionByName(inner), "done")
        ws.drop(done)
        done = newer
    return done.select("id", "parent", "root_id", "depth", "size", "pre", (F.col("pre") + F.col("span") - 1).alias("last"), "cyclic", "loop_id", "loop_at")


def _stack_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of a unit in pre-order, the ancestors of its first node before it: the stack is the path."""
    unit, stack, out, held = None, [], [], 0
    for batch in batches:
        for r, u, pre, last, i, own in zip(*(batch[c].tolist() for c in ("root_id", "unit", "pre", "last", "id", "own"))):
            if (r, u) != unit:
                unit, stack = (r, u), []
            while stack and stack[-1][0] < pre:
                stack.pop()
            stack.append((last, i))
            if own:
                out.append((i, [x for _, x in stack]))
                held += len(stack)
                if held > PATH_BATCH:
                    yield pd.DataFrame(out, columns=["id", "path"])
                    out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=["id", "path"])


def paths(tree: DataFrame, unit_nodes: int = 10_000, *, loops: bool = False) -> DataFrame:
    """(id, path): the ids from the root to each node, both included. Cyclic nodes have none, or with ``loops`` the ids from their loop_id on.
    Large trees are split into units of the pre-order."""
    tree = tree.withColumn("root_id", F.coalesce("loop_id", "root_id")) if loops else tree.where("NOT cyclic")
    at = tree.select("root_id", "id", "pre", "last", F.floor(F.col("pre") / unit_nodes).alias("unit"), F.lit(True).alias("own"))
    over = at.select("root_id", "id", "pre", "last", F.floor(F.col("last") / unit_nodes).alias("end"), "unit").where("end > unit")
    over = over.select("root_id", "id", "pre", "last", F.explode(F.sequence(F.col("unit") + 1, "end")).alias("unit"), F.lit(False).alias("own"))
    rows = at.unionByName(over).repartition("root_id", "unit").sortWithinPartitions("root_id", "unit", "pre")
    return rows.mapInPandas(_stack_paths, "id long, path array<long>")


def descendants(tree: DataFrame, *, loops: bool = False) -> DataFrame:
    """(id, descendant, distance): every node with each node below it. Cyclic nodes have none, or with ``loops`` all that they lead to: below
    a node on a cycle are the others on it and all that hangs below them, at the distance of the first time round."""
    at = paths(tree, loops=loops).select(F.col("id").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "id"))
    out = at.where("id <> descendant").select("id", "descendant", (F.col("n") - 1 - F.col("pos")).alias("distance"))
    if not loops:
        return out
    ring = tree.where("loop_at IS NOT NULL").select("root_id", F.col("id").alias("loop_id"), "loop_at")
    length = ring.groupBy("root_id").agg(F.count("*").alias("length"))
    above = ring.select("root_id", F.col("loop_id").alias("id"), F.col("loop_at").alias("above_at"))
    steps = F.pmod(F.col("loop_at") - F.col("above_at"), F.col("length"))
    apart = ring.join(length, "root_id").join(above, "root_id").where("id <> loop_id").select("id", "loop_id", steps.alias("steps"))
    hanging = paths(tree.where("cyclic"), loops=True).select(F.col("id").alias("descendant"), F.get("path", F.lit(0)).alias("loop_id"), (F.size("path") - 1).alias("deep"))
    return out.unionByName(apart.join(hanging, "loop_id").select("id", "descendant", (F.col("steps") + F.col("deep")).cast("int").alias("distance")))
