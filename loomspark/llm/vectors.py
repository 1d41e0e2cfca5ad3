"""The k most similar vectors by cross-polytope hashing.

A hash subtracts a centre, scales the rest to unit length, applies a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and takes the nearest signed axis. A table is a tree of such hashes: a bucket that holds too many rows is hashed again around
its own centre, with signs of its own, so dense regions are told apart as well as sparse ones. Several tables with different signs are
built; a query probes, in each, its own bucket and those reached over the next nearest axes, the closest calls first. Candidates are
ranked by their exact distance.

The trees are fitted on a bounded sample (SAMPLE_ROWS); every row is indexed. Where that sample is too coarse, the buckets that come out
too large are hashed on in further turns, each by a tree of its own that is fitted on a bounded sample of the bucket; these trees are
rows of a table, so neither their number nor the depth is bounded, and buckets keep their size however large the collection is. A bucket
that is still large, because its rows are alike, is cut into blocks and the queries that probe it go to each block, so no task holds a
whole bucket and no row is left out. Queries whose buckets held fewer than k rows are answered by comparing them with all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import Workspace, shuffle_partitions

#: Rows on which the hash trees are fitted, at most.
SAMPLE_ROWS = 40_000
#: Rows of a bucket above which it is hashed again.
BUCKET_ROWS = 4_000
#: Rows of a bucket on which its own tree is fitted, about, and rows of it that one task hashes on.
OWN_SAMPLE = 4_000
OWN_ROWS = 50_000
#: Rows of one block of a bucket, and queries of one block of those that probe it.
BLOCK_ROWS = 8_000
BLOCK_QUERIES = 4_000
#: Tables, and buckets that a query probes in each.
TABLES = 2
PROBES = 12


def usable(features: Column, dim: int) -> Column:
    """Not null, of full length, no element null, NaN or infinite."""
    bad = F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return features.isNotNull() & (F.size(features) == dim) & ~bad


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


@dataclass
class Node:
    centre: np.ndarray
    signs: np.ndarray
    children: dict[int, int] = field(default_factory=dict)
    bucket: int = -1


def _rotate(node: Node, x: np.ndarray) -> np.ndarray:
    """Unit residuals, rotated. A zero residual stays zero, so its nearest axis is the first."""
    r = x - node.centre
    norm = np.linalg.norm(r, axis=1, keepdims=True)
    r = np.divide(r, norm, out=np.zeros_like(r), where=norm > 0)
    y = np.zeros((len(r), node.signs.shape[1]))
    y[:, : r.shape[1]] = r
    for s in node.signs:
        y = _hadamard(y * s)
    return y


def _axis(y: np.ndarray) -> np.ndarray:
    """The nearest signed axis: 2 * axis, plus one if negative."""
    best = np.abs(y).argmax(axis=1)
    return 2 * best + (y[np.arange(len(y)), best] < 0)


class HashTree:
    """One table: nodes[0] is the root; a node without children is a bucket."""

    def __init__(self, sample: np.ndarray, bucket_rows: float, seed: int):
        self.width = 1 << max(1, (sample.shape[1] - 1).bit_length())
        self.nodes: list[Node] = []
        self.buckets = 0
        self._grow(sample, bucket_rows, np.random.RandomState(seed))

    def _grow(self, sample: np.ndarray, bucket_rows: float, rng: np.random.RandomState) -> None:
        todo = [(sample, None, 0)]
        while todo:
            rows, above, axis = todo.pop()
            node = Node(rows.mean(axis=0) if len(rows) else np.zeros(sample.shape[1]), rng.choice([-1.0, 1.0], size=(3, self.width)))
            at = len(self.nodes)
            self.nodes.append(node)
            if above is not None:
                self.nodes[above].children[axis] = at
            if len(rows) > max(bucket_rows, 2) and (rows != rows[0]).any():
                axes = _axis(_rotate(node, rows))
                todo += [(rows[axes == a], at, int(a)) for a in np.unique(axes)]
            else:
                node.bucket, self.buckets = self.buckets, self.buckets + 1

    def packed(self) -> bytes:
        return pickle.dumps((self.width, self.buckets, [(n.centre, n.signs, n.children, n.bucket) for n in self.nodes]))

    @classmethod
    def unpacked(cls, data: bytes) -> HashTree:
        tree = cls.__new__(cls)
        tree.width, tree.buckets, nodes = pickle.loads(data)
        tree.nodes = [Node(*n) for n in nodes]
        return tree

    def probe(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) pairs: the ``probes`` buckets of each row with the least loss, the row's own first.

        The loss of an axis is the squared distance, on the sphere, by which it is farther than the nearest axis that has a bucket. An
        axis that no sample row had isn't a bucket: rows of its own go to the nearest one that is.
        """
        rows, node, loss = np.arange(len(x)), np.zeros(len(x), dtype=int), np.zeros(len(x))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            nxt = []
            order = np.argsort(node, kind="stable")
            edges = np.flatnonzero(np.diff(node[order])) + 1
            for part in np.split(order, edges):
                at = self.nodes[node[part[0]]]
                if at.bucket >= 0:
                    done.append((rows[part], np.full(len(part), at.bucket), loss[part]))
                    continue
                y = _rotate(at, x[rows[part]])
                kids = np.fromiter(at.children, dtype=int)
                dot = y[:, kids // 2] * np.where(kids % 2, -1.0, 1.0)
                take = min(probes, len(kids))
                near = np.argpartition(-dot, take - 1, axis=1)[:, :take]
                score = np.take_along_axis(dot, near, axis=1)
                more = 2 * (score.max(axis=1, keepdims=True) - score)
                target = np.array([at.children[k] for k in kids])
                nxt.append((np.repeat(rows[part], take), target[near].ravel(), (loss[part][:, None] + more).ravel()))
            if not nxt:
                break
            rows, node, loss = (np.concatenate(c) for c in zip(*nxt))
            keep = _least(rows, loss, probes)
            rows, node, loss = rows[keep], node[keep], loss[keep]
        rows, bucket, loss = (np.concatenate(c) for c in zip(*done)) if done else (np.zeros(0, int),) * 3
        keep = _least(rows, loss, probes)
        return rows[keep], bucket[keep]


def _least(rows: np.ndarray, loss: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n least losses of each row."""
    order = np.lexsort((loss, rows))
    r = rows[order]
    first = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[place < n]


def _vectors(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), -1)


def _assigner(trees, probes: int):
    """(id, features) to (id, v, unit), one row for each bucket probed; v is the vector's bytes."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 2_000):
                part = batch.iloc[k : k + 2_000]
                x, ids = np.vstack(part["f"].to_numpy()), part["id"].to_numpy()
                v = np.array([r.tobytes() for r in x] + [None], dtype=object)[:-1]
                for t, tree in enumerate(trees):
                    rows, bucket = tree.probe(x, probes)
                    yield pd.DataFrame({"id": ids[rows], "v": v[rows], "unit": np.int64(t) * 2**32 + bucket})

    return assign


PLACED = "id long, v binary, unit long"


def _unit_tree(bucket_rows: int, seed: int):
    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(rows.sort_values("id")["v"])
        tree = HashTree(x, max(8, bucket_rows * len(x) / int(rows["n"].iloc[0])), seed)
        return pd.DataFrame({"unit": [key[0]], "tree": [tree.packed()], "buckets": [tree.buckets]})

    return fit


def _hash_on(probes: int):
    def place(key, rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(tree):
            return pd.DataFrame({"id": [], "v": [], "unit": [], "bucket": []})
        at, bucket = HashTree.unpacked(tree["tree"].iloc[0]).probe(_vectors(rows["v"]), probes)
        return pd.DataFrame({"id": rows["id"].to_numpy()[at], "v": rows["v"].to_numpy()[at], "unit": key[0], "bucket": bucket})

    return place


def _smaller(indexed: DataFrame, probing: DataFrame, bucket_rows: int, probes: int, seed: int, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hash the rows of too large buckets on until none is left that can be told apart: the index, the probes, and the rows of each bucket."""
    turn = 0
    done: list[str] = []
    sizes = ws.keep(indexed.groupBy("unit").agg(F.count("*").alias("t")), "sizes")
    while True:
        large = sizes.where(F.col("t") > 4 * bucket_rows)
        large = ws.keep(large.join(fixed, "unit", "left_anti") if done else large, "large")
        if large.isEmpty():
            return indexed, probing, sizes
        part = F.pmod(F.xxhash64(F.lit(seed + turn), "id"), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0) * OWN_SAMPLE / F.col("t"))
        picked = indexed.join(large, "unit").where(part).select("unit", "id", "v", F.col("t").alias("n"))
        trees = ws.keep(picked.groupBy("unit").applyInPandas(_unit_tree(bucket_rows, seed + turn), "unit long, tree binary, buckets long"), "trees")
        tasks = large.select("unit", F.greatest(F.lit(1), F.ceil(F.col("t") / OWN_ROWS).cast("int")).alias("m"))

        def on(df: DataFrame, probes: int) -> DataFrame:
            salted = df.join(tasks, "unit").withColumn("salt", F.pmod(F.xxhash64("id"), "m").cast("int")).select("id", "v", "unit", "salt")
            copies = trees.where("buckets > 1").join(tasks, "unit").select("unit", "tree", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt"))
            placed = salted.groupBy("unit", "salt").cogroup(copies.groupBy("unit", "salt")).applyInPandas(_hash_on(probes), "id long, v binary, unit long, bucket long")
            moved = placed.select("id", "v", F.xxhash64("unit", "bucket", F.lit(turn)).alias("unit"))
            return ws.keep(df.join(trees.where("buckets > 1").select("unit"), "unit", "left_anti").select("id", "v", "unit").unionByName(moved), "placed")

        indexed, probing = on(indexed, 1), on(probing, probes)
        alike = trees.where("buckets = 1").select("unit")
        fixed = alike if not done else fixed.unionByName(alike)
        done.append("turn")
        sizes = ws.keep(indexed.groupBy("unit").agg(F.count("*").alias("t")), "sizes")
        turn += 1


def _nearest(k: int):
    """Exact distances inside each unit of a partition sorted by unit; train rows come before the queries."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, train, asked = None, [], []

        def answer():
            if not train or not asked:
                return None
            t, q = pd.concat(train, ignore_index=True), pd.concat(asked, ignore_index=True)
            a, b = _vectors(t["v"]), _vectors(q["v"])
            # train ids ascending, so a stable sort breaks ties by id
            order = np.argsort(t["id"].to_numpy(), kind="stable")
            ids, a = t["id"].to_numpy()[order], a[order]
            take = min(k, len(ids))
            ids_out, d_out = [], []
            # short floats around the mean find all that may be among the k nearest; their distances are then worked out in full
            mean = a.mean(axis=0)
            near_a, near_b = (a - mean).astype(np.float32), (b - mean).astype(np.float32)
            aa = (near_a * near_a).sum(axis=1)
            room = np.float32(1e-5) * (aa.max() + (near_b * near_b).sum(axis=1, keepdims=True) + np.float32(1e-9))
            near_t = np.ascontiguousarray(near_a.T) * np.float32(-2)
            step = max(1, 2_000_000 // len(ids))
            for s in range(0, len(b), step):
                part = b[s : s + step]
                if take < len(ids):
                    d = near_b[s : s + step] @ near_t
                    d += aa
                    cut = np.partition(d, take - 1, axis=1)[:, take - 1 : take]
                    r, c = np.nonzero(d <= cut + room[s : s + step])
                else:
                    r, c = np.nonzero(np.ones((len(part), len(ids)), dtype=bool))
                exact = np.sqrt(((part[r] - a[c]) ** 2).sum(axis=1))
                best = _least_ties(r, exact, c, take)
                ids_out.append(ids[c[best]].reshape(-1, take))
                d_out.append(exact[best].reshape(-1, take))
            near, dist = np.vstack(ids_out), np.vstack(d_out)
            return pd.DataFrame({"id": q["id"], "near": [x.tobytes() for x in near], "dist": [x.tobytes() for x in dist]})

        for batch in batches:
            for u, part in batch.groupby("block", sort=False):
                if u != unit:
                    if (out := answer()) is not None:
                        yield out
                    unit, train, asked = u, [], []
                is_query = part["query"].to_numpy()
                if (~is_query).any():
                    train.append(part.loc[~is_query, ["id", "v"]])
                if is_query.any():
                    asked.append(part.loc[is_query, ["id", "v"]])
        if (out := answer()) is not None:
            yield out

    return search


def _merged(k: int):
    """Lists of near rows, sorted by query, to the k nearest of each query; a query's lists are reduced as they come."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        n = [len(x) // 8 for x in rows["near"]]
        q, near, dist = np.repeat(rows["id"].to_numpy(), n), np.frombuffer(b"".join(rows["near"]), dtype=np.int64), np.frombuffer(b"".join(rows["dist"]), dtype=np.float64)
        order = np.lexsort((near, dist, q))
        q, near, dist = q[order], near[order], dist[order]
        again = np.r_[False, (q[1:] == q[:-1]) & (near[1:] == near[:-1]) & (dist[1:] == dist[:-1])]
        q, near, dist = q[~again], near[~again], dist[~again]
        first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < k
        return pd.DataFrame({"id": q[keep], "near": near[keep], "dist": dist[keep], "rank": place[keep] + 1})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = rows["id"].to_numpy() == rows["id"].iloc[-1]  # its lists may go on
            if (~last).any():
                yield cut(rows[~last])
            own = cut(rows[last])
            held = pd.DataFrame({"id": own["id"].iloc[:1], "near": [own["near"].to_numpy().tobytes()], "dist": [own["dist"].to_numpy().tobytes()]})
        if held is not None:
            yield cut(held)

    return merge


def _least_ties(r: np.ndarray, d: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n least (distance, place) of each row, in that order."""
    order = np.lexsort((c, d, r))
    rr = r[order]
    first = np.r_[0, np.flatnonzero(np.diff(rr)) + 1]
    place = np.arange(len(rr)) - np.repeat(first, np.diff(np.r_[first, len(rr)]))
    return order[place < n]


def _once(df: DataFrame, id: str, features: str, dim: int) -> DataFrame:
    """(id, f): the usable rows, one for each id (of several the least vector)."""
    f = F.col(f"`{features}`").cast("array<double>")
    return df.select(F.col(f"`{id}`").cast("long").alias("id"), f.alias("f")).where(F.col("id").isNotNull() & usable(F.col("f"), dim)).groupBy("id").agg(F.min("f").alias("f"))


def nearest_vectors(
    queries: DataFrame,
    rows: DataFrame,
    k: int = 10,
    *,
    dim: int,
    query_id: str = "index_test",
    row_id: str = "index_train",
    features: str = "features",
    tables: int = TABLES,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 17,
) -> DataFrame:
    """The k nearest rows of each query by euclidean distance: columns query_id, row_id, distance, rank.

    Features that are null, of another length than ``dim``, or hold a null, NaN or infinite element aren't usable, and their rows are
    left out on both sides, as are null ids; an id that occurs several times counts once. Ties go to the smaller id. Each query has k
    neighbours, or all usable rows if there are fewer; no usable row gives none. The result is approximate: recall is measured in the
    tests; the distances are exact.
    """
    spark = rows.sparkSession
    ws, n = Workspace(spark), shuffle_partitions(spark)
    train = ws.keep(_once(rows, row_id, features, dim), "train")
    asked = ws.keep(_once(queries, query_id, features, dim), "asked")
    count = train.count()
    order = F.xxhash64(F.lit(seed), "id")
    part = min(1.0, 1.02 * sample_rows / max(1, count))
    picked = train.where(F.pmod(order, F.lit(1_000_000)) < int(np.ceil(part * 1_000_000))).select("f").limit(sample_rows).toPandas()
    sample = np.vstack(picked["f"].to_numpy()) if len(picked) else np.zeros((0, dim))
    per_row = max(1e-9, len(sample) / max(1, count))
    trees = [HashTree(sample, max(bucket_rows * per_row, 8), seed + t) for t in range(tables)]
    indexed = ws.keep(train.mapInPandas(_assigner(trees, 1), PLACED), "index")
    probing = ws.keep(asked.mapInPandas(_assigner(trees, probes), PLACED), "probes")
    indexed, probing, sizes = _smaller(indexed, probing, bucket_rows, probes, seed, ws)

    def searched(indexed: DataFrame, probing: DataFrame, sizes: DataFrame) -> DataFrame:
        """The k nearest rows of each query in the units that it has, by (unit, its row blocks, its query blocks)."""
        asked_of = probing.groupBy("unit").agg(F.count("*").alias("q"))
        blocks = sizes.join(asked_of, "unit").select("unit", F.ceil(F.col("t") / BLOCK_ROWS).cast("int").alias("tb"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("qb"))
        blocks = ws.keep(blocks, "blocks")

        def spread(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
            mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("o")
            at = df.join(blocks, "unit").select("id", "v", "unit", mine.alias("m"), every)
            t, q = ("o", "m") if query else ("m", "o")
            return at.select("id", "v", F.lit(query).alias("query"), F.xxhash64("unit", t, q).alias("block"))

        work = spread(indexed, "tb", "qb", False).unionByName(spread(probing, "qb", "tb", True))
        found = work.repartition(n, "block").sortWithinPartitions("block", "query").mapInPandas(_nearest(k), "id long, near binary, dist binary")
        return found.repartition(n, "id").sortWithinPartitions("id").mapInPandas(_merged(k), "id long, near long, dist double, rank int")

    best = ws.keep(searched(indexed, probing, sizes), "best")
    short = ws.keep(asked.join(best.where(F.col("rank") == min(k, count)).select("id"), "id", "left_anti"), "short")
    if count and not short.isEmpty():
        # all rows are one unit, in blocks
        whole = _assigner([HashTree(sample[:1], 1, seed)], 1)
        rest = searched(train.mapInPandas(whole, PLACED), short.mapInPandas(whole, PLACED), spark.createDataFrame([(0, count)], "unit long, t long"))
        best = best.join(short.select("id"), "id", "left_anti").unionByName(ws.keep(rest, "rest"))
    return best.select(F.col("id").alias(query_id), F.col("near").alias(row_id), F.col("dist").alias("distance"), "rank")
