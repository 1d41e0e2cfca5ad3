"""Triangles of each vertex, without a table of the pairs of edges that may close.

Edges run from the smaller id to the larger one and are written once: all of a vertex's larger neighbours, its list, are in one partition, in
order. A task holds the lists of a few partitions, a block, and streams the others past it. An edge (a, b) whose b has its list in the block closes
a triangle with every id that is in the lists of both ends; the shorter of the two is looked up in the other, so the ids looked up stay within
E ** 1.5 however many edges a vertex has. Disk holds the edges once; only they and the counts of each task are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import Workspace, shuffle_partitions

#: Edges of a block, of a streamed batch (a list is never divided), ids looked up at once, and rows handed over at once.
BLOCK, BATCH, LOOKED, ROWS = 6_000_000, 1 << 17, 1 << 20, 1 << 16
#: Slots of the table of a batch's edges: for each edge, and at least.
SLOTS, LEAST_BITS = 16, 16
_B, _A = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

UNIT = "unit int, lo int, hi int, pieces int, piece int, slice int, slices int"


def triangles_of(e: DataFrame) -> DataFrame:
    """(id, count) for the ids that are in a triangle of the links ``e`` (a, b with a < b, which may occur again)."""
    ws = Workspace(e.sparkSession)
    if e.schema["a"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        return _counts(e.select(F.col("a").cast("long"), F.col("b").cast("long")), ws)
    # other ids are numbered
    names = ws.keep(e.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.monotonically_increasing_id().alias("no")), "names")
    ends = e.join(names.select(F.col("id").alias("a"), F.col("no").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("no").alias("y")), "b")
    found = _counts(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), ws)
    return found.select(F.col("id").alias("no"), "count").join(names, "no").select("id", "count")


def _counts(e: DataFrame, ws: Workspace) -> DataFrame:
    spark, n = e.sparkSession, shuffle_partitions(e.sparkSession)
    part = lambda c: F.pmod(F.hash(c), F.lit(n))
    lists = ws.keep(e.repartition(n, "a").distinct().sortWithinPartitions("a", "b").select("a", "b", part("a").alias("pa"), part("b").alias("pb")), "lists")
    ws.sweep()
    files = lists.select("pa", F.col("_metadata.file_path").alias("path")).groupBy("pa", "path").agg(F.count("*").alias("n"))
    parts = [(r.pa, r.n, r.paths) for r in files.groupBy("pa").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("path")).alias("paths")).orderBy("pa").collect()]
    blocks = list(_blocks([(p, rows) for p, rows, _ in parts], BLOCK))
    slices = min(len(parts), math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, len(blocks))))
    units = [(k * slices + s, *block, s, slices) for k, block in enumerate(blocks) for s in range(slices)]
    found = spark.createDataFrame(units, UNIT).repartitionById(max(1, len(units)), F.col("unit")).mapInArrow(_counting([(p, paths) for p, _, paths in parts]), "id long, n long")
    counts = ws.keep(found.groupBy("id").agg(F.sum("n").alias("count")), "counts")
    ws.drop(lists)
    return counts


def _blocks(parts: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int, int, int]]:
    """(first partition, last, pieces, piece): partitions together as far as they fit, one that is larger in pieces by its ids."""
    lo = hi = None
    held = 0
    for p, rows in parts:
        if lo is not None and held + rows > most:
            yield lo, hi, 1, 0
            lo, held = None, 0
        if rows > most:
            pieces = math.ceil(rows / most)
            yield from ((p, p, pieces, k) for k in range(pieces))
            continue
        lo, hi, held = p if lo is None else lo, p, held + rows
    if lo is not None:
        yield lo, hi, 1, 0


def _piece(ids: np.ndarray, pieces: int) -> np.ndarray:
    return (ids.astype(np.uint64) * _A >> np.uint64(33)) % np.uint64(pieces)


def _read(paths: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for path in paths:
        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_file(inner) as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH, columns=columns, use_threads=False):
                yield [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def _whole(paths: list[str]) -> Iterator[list[np.ndarray]]:
    """Batches of a, b, pb that end where a list ends."""
    rest: list[list[np.ndarray]] = []
    for batch in _read(paths, ["a", "b", "pb"]):
        a = batch[0]
        if not len(a):
            continue
        # all of it goes on the rest if it is one list; else up to its last list
        end = int(np.searchsorted(a, a[-1]))
        if end or rest and rest[-1][0][-1] != a[0]:
            head = [c[:end] for c in batch]
            yield [np.concatenate(x) for x in zip(*rest, head)]
            rest = []
        rest.append([c[end:] for c in batch])
    if rest:
        yield [np.concatenate(x) for x in zip(*rest)]


def _find(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``want`` stands in values[lo:hi], which is in order, and whether it does."""
    end = hi
    while (left := lo < hi).any():
        mid = (lo + hi) >> 1
        low = left & (values[np.minimum(mid, len(values) - 1)] < want)
        lo, hi = np.where(low, mid + 1, lo), np.where(left & ~low, mid, hi)
    return lo, (lo < end) & (values[np.minimum(lo, len(values) - 1)] == want)


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Slices whose sizes come to LOOKED at most, or that are one long."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOOKED, "right")))
        yield slice(at, to)
        at = to


def _each(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of the sizes, one after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Block:
    """Lists of the ids ``ys``: z[at : at + size] each. ``nz`` and ``ny`` count the triangles by their last and their middle id."""

    def __init__(self, paths: list[str], pieces: int, piece: int):
        z, ys, at, size, held = [np.empty(0, np.int64)], [], [], [], 0
        for a, b in _read(paths, ["a", "b"]):
            if pieces > 1:
                keep = _piece(a, pieces) == piece
                a, b = a[keep], b[keep]
            if not len(a):
                continue
            new = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
            ys.append(a[new])
            at.append(new + held)
            size.append(np.diff(new, append=len(a)))
            held += len(a)
            z.append(b)
        self.z = np.concatenate(z)
        ys, at, size = (np.concatenate([np.empty(0, np.int64), *x]) for x in (ys, at, size))
        # a list that two batches hold goes on where it stopped
        order = np.lexsort((at, ys))
        ys, at, size = ys[order], at[order], size[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(ys)), bool), ys[1:] != ys[:-1]]))
        self.ys, self.at, self.size = ys[new], at[new], np.add.reduceat(size, new) if len(new) else size
        self.ny, self.nz = np.zeros(len(self.ys), np.int64), np.zeros(len(self.z), np.int64)
        self.table = np.zeros(1 << LEAST_BITS, bool)

    def count(self, a: np.ndarray, b: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole lists (a, b) and the triangles each is the first id of, by the edges ``mine``."""
        new = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
        sizes = np.diff(new, append=len(a))
        nx = np.zeros(len(new), np.int64)
        if not len(self.ys):
            return a[new], nx
        owner, end = np.repeat(np.arange(len(new)), sizes), np.repeat(new + sizes, sizes)
        y = np.searchsorted(self.ys, b[mine])
        y[y == len(self.ys)] = 0
        there = (self.ys[y] == b[mine]) & (end[mine] > mine + 1)
        e, y = mine[there], y[there]
        after = end[e] - e - 1  # ids of a's list above b
        short = after * 4 < self.size[y]  # looking up in the block costs more

        def found(e: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
            np.add.at(nx, owner[e], 1)
            np.add.at(self.ny, y, 1)
            np.add.at(self.nz, z, 1)

        if not short.all():
            bits = max(LEAST_BITS, math.ceil(math.log2(len(a) * SLOTS)))
            if len(self.table) < 1 << bits:
                self.table = np.zeros(1 << bits, bool)
            by, shift = owner.astype(np.uint64) * _A, np.uint64(64 - bits)
            slots = b.astype(np.uint64) * _B + by >> shift
            self.table[slots] = True
            pe, py = e[~short], y[~short]
            for k in _runs(self.size[py]):
                ce, cy, n = pe[k], py[k], self.size[py[k]]
                z = _each(self.at[cy], n)
                h = self.z[z].view(np.uint64)
                h *= _B
                h += np.repeat(by[ce], n)
                h >>= shift
                hit = np.flatnonzero(self.table[h])  # the table also lets some through that aren't in the list
                pair = np.searchsorted(np.cumsum(n), hit, "right")
                z, he = z[hit], ce[pair]
                ok = _find(b, he + 1, end[he], self.z[z])[1]
                found(he[ok], cy[pair[ok]], z[ok])
            self.table[slots] = False
        pe, py = e[short], y[short]
        for k in _runs(after[short]):
            ce, cy, n = pe[k], py[k], after[short][k]
            c, pair = _each(ce + 1, n), np.repeat(np.arange(len(n)), n)
            z, ok = _find(self.z, self.at[cy][pair], (self.at + self.size)[cy][pair], b[c])
            found(ce[pair[ok]], cy[pair[ok]], z[ok])
        return a[new], nx

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids that stand in the middle or last, and their triangles."""
        at = np.flatnonzero(self.nz)
        ids, n = np.concatenate([self.z[at], self.ys]), np.concatenate([self.nz[at], self.ny])
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], n[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
        return ids[new], np.add.reduceat(n, new) if len(new) else n


def _counting(parts: list[tuple[int, list[str]]]):
    def run(batches):
        import pyarrow as pa

        def rows(ids: list[np.ndarray], n: list[np.ndarray]):
            ids, n = np.concatenate(ids), np.concatenate(n)
            for k in range(0, len(ids), ROWS):
                yield pa.record_batch([pa.array(ids[k : k + ROWS]), pa.array(n[k : k + ROWS])], ["id", "n"])

        for u in (u for batch in batches for u in batch.to_pylist()):
            block = _Block([f for p, paths in parts if u["lo"] <= p <= u["hi"] for f in paths], u["pieces"], u["piece"])
            ids, n, held = [], [], 0
            for _, paths in parts[u["slice"] :: u["slices"]]:
                for a, b, pb in _whole(paths):
                    mine = (pb >= u["lo"]) & (pb <= u["hi"])
                    if u["pieces"] > 1:
                        mine &= _piece(b, u["pieces"]) == u["piece"]
                    x, nx = block.count(a, b, np.flatnonzero(mine))
                    some = nx > 0
                    ids.append(x[some])
                    n.append(nx[some])
                    held += int(some.sum())
                    if held >= ROWS:
                        yield from rows(ids, n)
                        ids, n, held = [], [], 0
            x, nx = block.counts()
            some = nx > 0
            yield from rows([*ids, x[some]], [*n, nx[some]])

    return run
