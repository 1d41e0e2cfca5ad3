"""Consolidating pairwise matches into groups by seed-tree pruning.

In every round each vertex connects to the minimum of its neighbourhood, itself included. A vertex that is nobody's minimum drops out:
it hangs in the propagation forest below the minimum it chose. Each link goes on as one link between the minima that its two ends chose,
so there are never more links than at first, and the vertices left are those that some vertex chose. Without links what is left are the
seeds, and their ids flow down the forest, the rounds in reverse order.

What is a minimum is decided in each round by another permutation of the ids. In the order of the ids themselves, a chain of consecutive
ids would lose one vertex in a round; in a random order about half of a chain's vertices are no one's minimum, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import Workspace

_LOW = 0xFFFFFFFF


def _halves(x: str) -> tuple[str, str]:
    return f"shiftrightunsigned({x}, 32)", f"({x} & {_LOW}L)"


def _turned(half: str, turn: int, step: int) -> str:
    # a string, unlike a number, is no part of the generated code, so all rounds share what was compiled for the first
    return f"(xxhash64({half}, '{turn} {step}') & {_LOW}L)"


def mixed(x: str, turn: int) -> str:
    """The place of a 64-bit id in the permutation of a round, as SQL: three steps of a Feistel network, so no two ids share a place."""
    high, low = _halves(x)
    for step in range(3):
        high, low = low, f"({high} ^ {_turned(low, turn, step)})"
    return f"(shiftleft({high}, 32) | {low})"


def unmixed(x: str, turn: int) -> str:
    """The id at a place of the permutation."""
    high, low = _halves(x)
    for step in reversed(range(3)):
        high, low = f"({low} ^ {_turned(high, turn, step)})", high
    return f"(shiftleft({high}, 32) | {low})"


def consolidate(pairs: DataFrame, a: str = "id_a", b: str = "id_b", *, max_rounds: int = 200, log: list[int] | None = None) -> DataFrame:
    """One row (id, group_id) for each id of ``pairs``; group_id is the smallest id reachable over the pairs.

    Pairs are undirected and their ids are whole numbers (of at most 64 bits). Rows with a null id are left out, and so are self-pairs:
    an id that occurs in nothing else is in no row. Repeated and reversed pairs count once; an empty table gives no rows; other columns
    are ignored. ``log``, if given, receives the number of links at the start of every round.
    """
    ws = Workspace(pairs.sparkSession)
    x, y = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    ends = pairs.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), (x.isNotNull() & y.isNotNull() & (x != y)).alias("ok"))
    links = ws.keep(ends.where("ok").select("u", "v").distinct(), "links")
    forest: list[DataFrame] = []
    while n := links.count():
        if log is not None:
            log.append(n)
        turn = len(forest)
        if turn == max_rounds:
            raise RuntimeError(f"{n} links are left after {max_rounds} rounds")
        both = links.selectExpr("u", f"{mixed('v', turn)} AS x").union(links.selectExpr("v", f"{mixed('u', turn)} AS x"))
        chosen = both.groupBy("u").agg(F.min("x").alias("x")).selectExpr("u", f"least(x, {mixed('u', turn)}) AS x")
        forest.append(ws.keep(chosen.selectExpr("u", f"{unmixed('x', turn)} AS m"), "forest"))
        p, q = forest[-1].selectExpr("u", "m AS p"), forest[-1].selectExpr("u AS v", "m AS q")
        fewer = links.join(p, "u").join(q, "v").where("p <> q").selectExpr("least(p, q) AS u", "greatest(p, q) AS v").distinct()
        fewer = ws.keep(fewer, "links")
        ws.drop(links)
        links = fewer
    if not forest:
        return links.selectExpr("u AS id", "v AS group_id")
    named = None
    for level in reversed(forest):
        # a minimum that no further round has is a seed
        if named is None:
            flowed = level.selectExpr("u AS id", "m AS seed")
        else:
            flowed = level.join(named.selectExpr("id AS m", "seed"), "m", "left").selectExpr("u AS id", "coalesce(seed, m) AS seed")
        flowed = ws.keep(flowed, "named")
        ws.drop(named, level)
        named = flowed
    least = named.groupBy("seed").agg(F.min("id").alias("group_id"))
    return named.join(least, "seed").select("id", "group_id")
