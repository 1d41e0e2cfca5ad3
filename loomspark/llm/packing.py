"""Filling fixed-capacity containers by bin completion.

Documents are measured in tokens and dealt to shards of bounded size. In a shard, containers are filled one after another around the
largest document left, with the undominated fillings: nothing left fits beside them, and no other filling has documents into which this
one's could be put. The fullest come first. A branch is given up by its waste: when the containers it has used and those that the rest
needs at least aren't fewer than the best solution's. What the rest needs follows from its tokens, and from its large documents, which
can't share a container. The best-fit solution is the first incumbent, and a shard ends at once when its incumbent meets the bound.

Without limits (``looked``, ``kept`` and ``nodes`` None) the search is exact. That takes time exponential in the shard's documents, so by
default a container's fillings and a shard's steps are limited; the incumbent then stands, with all documents in it.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import Workspace

#: Documents of a shard, about. A shard leaves at most a container's worth of room more than all together would.
SHARD_DOCS = 5_000
#: By default: fillings of one container that are looked at and that are branched on, and containers filled in a search for each of the incumbent's.
LOOKED, KEPT, NODES = 300, 3, 4
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the documents of b can be put into those of a, as if these were containers. Both descending."""

    def put(k: int, rooms: list[int]) -> bool:
        if k == len(b):
            return True
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= b[k] and put(k + 1, [*rooms[:i], rooms[i] - b[k], *rooms[i + 1 :]]):
                return True
        return False

    return sum(a) >= sum(b) and put(0, list(a))


def fillings(left: dict[int, int], sizes: list[int], room: int, looked: int | None = LOOKED, kept: int | None = KEPT) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, the fullest first. sizes: the sizes left, ascending; left: how many of each."""
    found: list[tuple[int, ...]] = []
    steps = 0

    def grow(chosen: list[int], free: int, top: int) -> bool:
        """Whether to stop: the room is full, or enough has been looked at."""
        nonlocal steps
        steps += 1
        least = next((s for s in sizes if left[s] > chosen.count(s)), free + 1)
        if least > free:
            found.append(tuple(chosen))
            return free == 0
        for at in range(bisect_right(sizes, free, hi=top) - 1, -1, -1):
            s = sizes[at]
            if left[s] > chosen.count(s) and grow([*chosen, s], free - s, at + 1):
                return True
            if looked is not None and steps >= looked:
                return True
        return False

    grow([], room, len(sizes))
    found.sort(key=lambda c: (-sum(c), len(c)))
    best: list[tuple[int, ...]] = []
    for c in found:
        if not any(dominates(k, c) for k in best):
            best.append(c)
            if len(best) == kept:
                break
    return best


def least_containers(sizes: list[int], capacity: int) -> int:
    """A bound from below (Martello and Toth's L2): for each small size, documents of less than it are left out, those of more than half a
    container have one each, and the rest fills what room these leave."""
    if not sizes:
        return 0
    s = np.sort(np.asarray(sizes, dtype=np.int64))
    total = np.r_[0, np.cumsum(s)]
    half = np.searchsorted(s, capacity / 2, side="right")
    small = np.unique(np.r_[0, s[:half]])
    large = np.searchsorted(s, capacity - small, side="right")  # from here on nothing of at least ``small`` fits beside
    from_small = np.searchsorted(s, small)
    room = (large - half) * capacity - (total[large] - total[half])
    rest = np.maximum(0, total[half] - total[from_small] - room)
    return int((len(s) - half + -(-rest // capacity)).max())


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for s in sorted(sizes, reverse=True):
        at = bisect_right(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        insort(rooms, (room - s, b))
    return bins


def complete(sizes: list[int], capacity: int, *, looked: int | None = LOOKED, kept: int | None = KEPT, nodes: int | None = NODES) -> list[list[int]]:
    """Bin completion of sizes that are all within the capacity."""
    best = best_fit(sizes, capacity)
    need = least_containers(sizes, capacity)
    if len(best) <= need:
        return best
    most, steps = None if nodes is None else nodes * len(best), 0
    left: dict[int, int] = {}
    for s in sizes:
        left[s] = left.get(s, 0) + 1
    order = sorted(left)
    total = sum(sizes)
    path: list[tuple[list[int], list[tuple[int, ...]]]] = []

    def take(content: list[int], sign: int) -> None:
        nonlocal total
        for s in content:
            left[s] = left.get(s, 0) - sign
            if left[s] == 0:
                order.remove(s)
            elif sign < 0 and left[s] == 1:
                insort(order, s)
            total -= sign * s

    def options() -> list[tuple[int, ...]]:
        largest = order[-1]
        left[largest] -= 1
        if not left[largest]:
            order.pop()
        out = [(largest, *c) for c in fillings(left, order, capacity - largest, looked, kept)]
        left[largest] += 1
        if left[largest] == 1:
            order.append(largest)
        return out[::-1]

    todo = options()
    while (most is None or steps < most) and len(best) > need:
        if not todo:
            if not path:
                break
            content, todo = path.pop()
            take(content, -1)
            continue
        content = list(todo.pop())
        take(content, 1)
        path.append((content, todo))
        steps += 1
        used = len(path)
        if not total:
            if used < len(best):
                best = [list(c) for c, _ in path]
            todo = []
        elif used + -(-total // capacity) >= len(best) or len(order) < 50 and used + least_containers([s for s in order for _ in range(left[s])], capacity) >= len(best):
            todo = []
        else:
            todo = options()
    return best


def token_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", by: str | None = None, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc, tokens, by) of the texts that have any; ``tokenizer`` is a file of the tokenizers library that every executor can read."""
    kind = documents.schema[by].dataType.simpleString() if by else "string"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.iloc[k : k + 200]
                yield pd.DataFrame({"doc": part["doc"], "tokens": [len(e.ids) for e in t.encode_batch(part["text"].tolist(), add_special_tokens=False)], "by": part["by"]})

    group = F.col(f"`{by}`") if by else F.lit(None).cast("string")
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), group.alias("by")).where("doc IS NOT NULL AND length(text) > 0")
    return docs.mapInPandas(count, f"doc long, tokens long, by {kind}").groupBy("doc").agg(F.max("tokens").alias("tokens"), F.min("by").alias("by")).where("tokens > 0")


def _pack(capacity: int, limits: dict):
    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        waiting: dict[int, list[tuple[int, int]]] = {}
        out, box = [], int(key[1]) << 32
        for doc, tokens in sorted(zip(rows["doc"].tolist(), rows["tokens"].tolist())):
            piece = 0
            while tokens > capacity:  # only a document above the capacity is split: full containers, and the rest like any other
                out.append((doc, piece, capacity, box))
                box, piece, tokens = box + 1, piece + 1, tokens - capacity
            if tokens:
                waiting.setdefault(tokens, []).append((doc, piece))
        for content in complete([s for s, docs in waiting.items() for _ in docs], capacity, **limits):
            out += [(*waiting[s].pop(), s, box) for s in content]
            box += 1
        return pd.DataFrame(out, columns=["doc", "piece", "tokens", "container"]).assign(by=rows["by"].iloc[0])

    return pack


def pack_documents(
    documents: DataFrame,
    capacity: int,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    by: str | None = None,
    tokenizer: str = DEFAULT_TOKENIZER,
    shard_docs: int = SHARD_DOCS,
    **limits: int | None,
) -> DataFrame:
    """(doc_id, piece, tokens, container): each document in one container of ``capacity`` tokens; one above the capacity in several pieces.

    With ``by``, a column's name, containers hold documents of one value of it only (nulls are one more); the result has that column too, and
    containers are numbered within its values. Null ids and texts without tokens (null, empty) are in no container; an id that occurs
    several times counts once, with its longest text and least ``by``; an empty table gives no rows. ``limits``: looked, kept and nodes of
    :func:`complete`.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    sizes = Workspace(documents.sparkSession).keep(token_counts(documents, doc_id=doc_id, text=text, by=by, tokenizer=tokenizer), "sizes")
    kind = sizes.schema["by"].dataType.simpleString()
    shards = sizes.groupBy(F.col("by").alias("of")).agg(F.ceil(F.count("*") / shard_docs).cast("int").alias("shards"))
    dealt = sizes.join(shards, F.col("by").eqNullSafe(F.col("of"))).select("doc", "tokens", "by", F.pmod(F.xxhash64("doc"), F.col("shards")).alias("shard"))
    packed = dealt.groupBy("by", "shard").applyInPandas(_pack(capacity, limits), f"doc long, piece int, tokens long, container long, by {kind}")
    return packed.select(F.col("doc").alias(doc_id), "piece", "tokens", "container", *([F.col("by").alias(by)] if by else []))
