"""Grouping records into similarity clusters: MinHash banding, exact Jaccard, connected components, loose ones split around medoids.

A record's vector is read as a set: in every dimension, ``shifts`` grids of the same width, each shifted a little further, and the cell
the value falls in on each grid is one element. Two vectors share, in each dimension, about 1 - |difference| / width of the elements, so
the Jaccard similarity of the sets bounds the distance: vectors within ``radius`` have at least :func:`least_jaccard`. MinHash signatures
of the sets are cut into bands; records that agree in a band are candidates. Inside a band's bucket no pairs are listed: every record is
verified against a pivot, those that fail against the verified ones and then among themselves, and only links that join something come
out. Verifying means the exact Jaccard similarity of the sets, which is worked out from the records' places on the lattice that all
grids form together, and, for those that have it, the exact distance. The links' connected components are the groups.

Records are shuffled once, not once for each band: space is cut into leaves (planes that few records of a sample are near), and a record
within ``radius`` above a plane's lower side goes to both sides, so any two records within ``radius`` meet in some leaf. A leaf is one
task's: its bands, verified links and components stay there. Components without a record that is in several units are done in it; only
the others are joined by :func:`consolidate`.

A leaf too large for a task that no plane cuts is dense: records within ``radius`` of a pivot from the sample are linked with it wherever
they are, and are spread over units; records that may be linked with one of them (within twice ``radius`` of the pivot) visit all its
units. Where pivots don't take enough, the leaf's other records are joined by shuffled bands. Buckets of these above HOT_ROWS are split:
their records go to several tasks, each with a copy of the pivot, and the (few) that fail it are replicated to these tasks and go through
the next turn as a bucket of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.links import consolidate
from loomspark.llm.vectors import _once
from loomspark.session import Workspace, shuffle_partitions

#: Elements of a record's set, about: the grids of each dimension are as many as give this number.
ELEMENTS = 128
#: Bands and signature rows in each. Two records at the radius have a Jaccard similarity of about 0.84 at least (0.74 is sure) and share a
#: band with a probability above 0.9999 (0.998); a record is lost only if it shares none with any of its cluster.
BANDS, BAND_ROWS = 12, 3
#: Records of a bucket above which it is split over tasks; members of a component above which its medoids are chosen in distributed turns.
HOT_ROWS = 20_000
LOOSE_ROWS = 5_000
#: Pairs verified at once.
PAIRS = 500_000
#: Sampled rows by which space is cut; bytes of a leaf's vectors above which it goes to several tasks; fewest rows that are cut.
SAMPLE_ROWS = 60_000
LEAF_BYTES = 32_000_000
LEAF_ROWS = 5_000
#: Width of a grid in radii.
WIDTH = 4.0
#: Multiplier and shift of the 64-bit mixing steps.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_jaccard(radius: float, dim: int, width: float, shifts: int) -> float:
    """The Jaccard similarity that two vectors within ``radius`` have at least: their coordinates differ by at most radius * sqrt(dim) in all."""
    n = dim * shifts
    common = max(0.0, n - shifts * np.sqrt(dim) * radius / width - dim)
    return common / (2 * n - common)


def _cells(x: np.ndarray, width: float, shifts: int) -> np.ndarray:
    """The element of each dimension and grid, as cell numbers in fixed places: rows agree in a place if they share that element."""
    shift = np.arange(shifts) * (width / shifts)
    return np.floor((x[:, :, None] + shift) / width).astype(np.int64).reshape(len(x), -1)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def band_keys(x: np.ndarray, width: float, shifts: int, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One key for each record and band."""
    cells = _cells(x, width, shifts)
    with np.errstate(over="ignore"):
        place = _mix(np.arange(1, cells.shape[1] + 1, dtype=np.uint64) * _MIX)
        element = _mix(cells.astype(np.uint64) * _MIX + place)
        keys = np.empty((len(x), bands), dtype=np.uint64)
        for b in range(bands):
            key = np.full(len(x), b + 1, dtype=np.uint64) * _MIX
            for r in range(rows):
                # multiply-shift by an odd number of each function's own; the least product decides
                odd = _mix(np.array([b * rows + r + 1], dtype=np.uint64) * _MIX) | np.uint64(1)
                key = _mix(key + (element * odd).min(axis=1))
            keys[:, b] = key
    return keys.astype(np.int64)


def _banded(dim: int, width: float, shifts: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 2000):
                part = batch.iloc[s : s + 2000]
                keys = band_keys(_matrix(part["v"], dim), width, shifts)
                yield pd.DataFrame({"bk": keys.ravel(), "id": np.repeat(part["id"].to_numpy(), keys.shape[1]), "v": np.repeat(part["v"].to_numpy(), keys.shape[1])})

    return make


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v), dtype=np.float64).reshape(-1, dim)


class Verifier:
    """Exact Jaccard of the sets, then the exact distance."""

    def __init__(self, dim: int, radius: float, width: float, shifts: int):
        self.dim, self.radius, self.width, self.shifts = dim, radius, width, shifts
        self.n = dim * shifts
        self.least = least_jaccard(radius, dim, width, shifts)

    def lattice(self, x: np.ndarray) -> np.ndarray:
        """Places on the lattice of all grids' lines. Of ``shifts`` lines in a row each belongs to another grid, so two values are in different
        cells on as many grids as there are lines between them (on all, if there are more)."""
        return np.floor(x * (self.shifts / self.width))

    def jaccard(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The Jaccard similarity of the sets of rows that are at ``p`` and at ``q`` on the lattice."""
        if p.shape == q.shape:
            common = np.maximum(self.shifts - np.abs(p - q), 0).sum(axis=-1)
        else:
            common = np.zeros(np.broadcast_shapes(p.shape, q.shape)[:-1])
            for d in range(self.dim):
                common += np.maximum(self.shifts - np.abs(p[..., d] - q[..., d]), 0)
        return common / (2 * self.n - common)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row i of a and row i of b are linked."""
        out = np.zeros(len(a), dtype=bool)
        at = np.flatnonzero(self.jaccard(self.lattice(a), self.lattice(b)) >= self.least)
        out[at] = ((a[at] - b[at]) ** 2).sum(axis=1) <= self.radius**2
        return out

    def first_links(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """For each row of r the place of one row of s that it is linked to, -1 if there is none."""
        out = np.full(len(r), -1)
        at, to = self.lattice(r), self.lattice(s)
        step = max(1, 1_000_000 // max(1, len(s)))
        for k in range(0, len(r), step):
            i, j = np.nonzero(self.jaccard(at[k : k + step, None, :], to[None]) >= self.least)
            ok = ((r[k + i] - s[j]) ** 2).sum(axis=1) <= self.radius**2
            i, j = i[ok], j[ok]
            out[k + i[::-1]] = j[::-1]
        return out


def _link_buckets(check: Verifier):
    """(bk, id, v) sorted by bk and id, whole buckets, to links (a, b) that connect all of a bucket that is connected in it."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        """All buckets take their turns together: the rows left are verified against their bucket's first one, those that fail against the verified
        ones, and those go into the next turn."""
        bk, ids, x = rows["bk"].to_numpy(), rows["id"].to_numpy(), _matrix(rows["v"], check.dim)
        at = check.lattice(x)

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = check.jaccard(at[i], at[j]) >= check.least
            near = np.flatnonzero(out)
            out[near] = ((x[i[near]] - x[j[near]]) ** 2).sum(axis=1) <= check.radius**2
            return out

        a, b, left = [ids[:0]], [ids[:0]], np.arange(len(bk))
        while len(left):
            first = np.r_[0, np.flatnonzero(bk[left][1:] != bk[left][:-1]) + 1]
            size = np.diff(np.r_[first, len(left)])
            pivot = np.repeat(left[first], size)
            ok = np.concatenate([linked(left[k : k + PAIRS], pivot[k : k + PAIRS]) for k in range(0, len(left), PAIRS)])
            ok[first] = True
            star = ok & (left != pivot)
            a.append(ids[left[star]])
            b.append(ids[pivot[star]])
            good, failed = left[star], left[~ok]
            # the verified rows of each failed row's bucket, but for the pivot
            start = np.searchsorted(bk[good], bk[failed], side="left")
            n = np.searchsorted(bk[good], bk[failed], side="right") - start
            edges = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1
            for part in np.split(np.arange(len(failed)), edges):
                m = n[part]
                of = np.repeat(part, m)
                to = np.repeat(start[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                hit = np.flatnonzero(linked(failed[of], good[to]))
                one, where = np.unique(of[hit], return_index=True)
                a.append(ids[failed[one]])
                b.append(ids[good[to[hit[where]]]])
            left = failed
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            bk = rows["bk"].to_numpy()
            done = np.searchsorted(bk, bk[-1])  # the last bucket may go on
            if done:
                yield whole(rows.iloc[:done])
            held = rows.iloc[done:]
        if held is not None and len(held):
            yield whole(held)

    return link


def _star_shards(check: Verifier):
    """A shard of a large bucket: rows with their pivot, to links and to those that fail (b is null)."""

    def star(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = check.pairs(_matrix(batch["v"], check.dim), _matrix(batch["pv"], check.dim)) | (batch["id"] == batch["pid"]).to_numpy()
            yield pd.DataFrame({"bk": batch["bk"], "id": batch["id"], "v": batch["v"], "b": batch["pid"].where(ok).astype("Int64")})

    return star


def _rest_shards(check: Verifier):
    """(verified rows, failed rows) of one unit to links between them."""

    def link(_, rows: pd.DataFrame) -> pd.DataFrame:
        fail = rows["b"].isna().to_numpy()
        x, ids = _matrix(rows["v"], check.dim), rows["id"].to_numpy()
        at = check.first_links(x[fail], x[~fail]) if fail.any() and (~fail).any() else np.zeros(0, int)
        return pd.DataFrame({"a": ids[fail][: len(at)][at >= 0], "b": ids[~fail][at[at >= 0]] if len(at) else np.zeros(0, np.int64)})

    return link


def similar_links(records: DataFrame, dim: int, radius: float, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Verified links (a, b) of ``records`` (id, v) that connect all records that links connect inside some band's bucket."""
    spark = records.sparkSession
    ws, n = Workspace(spark), shuffle_partitions(spark)
    width, shifts = WIDTH * radius, max(4, ELEMENTS // dim)
    check = Verifier(dim, radius, width, shifts)
    rows = records.mapInPandas(_banded(dim, width, shifts), "bk long, id long, v binary")
    rows = ws.keep(rows, "bands")
    found = []
    while True:
        sizes = rows.groupBy("bk").agg(F.count("*").alias("n"), F.min("id").alias("pid"))
        hot = ws.keep(sizes.where(F.col("n") > hot_rows), "hot")
        some = not hot.isEmpty()
        cool = rows.join(hot.select("bk"), "bk", "left_anti") if some else rows
        found.append(ws.keep(cool.repartition(n, "bk").sortWithinPartitions("bk", "id").mapInPandas(_link_buckets(check), "a long, b long").distinct(), "links"))
        if not some:
            break
        shards = F.ceil(F.col("n") / hot_rows).cast("int")
        pivot = hot.join(rows, "bk").where("id = pid").select("bk", "pid", F.col("v").alias("pv"), F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
        split = rows.join(F.broadcast(hot.select("bk", shards.alias("m"))), "bk").withColumn("shard", F.pmod(F.xxhash64("id"), "m").cast("int"))
        star = split.join(pivot, ["bk", "shard"]).select("bk", "id", "v", "pid", "pv").mapInPandas(_star_shards(check), "bk long, id long, v binary, b long")
        star = ws.keep(star, "stars")
        found.append(star.where("b IS NOT NULL AND b <> id").select(F.col("id").alias("a"), "b"))
        rest = star.where("b IS NULL")
        per = star.groupBy("bk").agg(F.ceil(F.count("b") / hot_rows).cast("int").alias("m"), F.ceil(F.count_if(F.col("b").isNull()) / hot_rows).cast("int").alias("k")).where("k > 0")
        per = ws.keep(per, "rest")
        if per.isEmpty():
            break
        good = star.where("b IS NOT NULL").join(per, "bk").select("bk", "id", "v", "b", F.pmod(F.xxhash64("id"), "m").alias("s"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("r"))
        bad = rest.join(per, "bk").select("bk", "id", "v", "b", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("s"), F.pmod(F.xxhash64("id"), "k").alias("r"))
        units = good.select("bk", "id", "v", "b", F.col("s").cast("int"), F.col("r").cast("int")).unionByName(bad.select("bk", "id", "v", "b", F.col("s").cast("int"), F.col("r").cast("int")))
        found.append(ws.keep(units.groupBy("bk", "s", "r").applyInPandas(_rest_shards(check), "a long, b long"), "across"))
        rows = ws.keep(rest.select("bk", "id", "v"), "bands")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _medoids(ids: np.ndarray, x: np.ndarray, radius: float) -> np.ndarray:
    """The cluster of each member of a loose component, in the order of ids: the member with most others within ``radius`` takes them, then the next
    of what is left."""
    near = np.concatenate([((x[k : k + 100, None, :] - x[None]) ** 2).sum(axis=2) <= radius**2 for k in range(0, len(x), 100)])
    degree, medoid, left = near.sum(axis=1), np.zeros(len(ids), dtype=np.int64), np.ones(len(ids), dtype=bool)
    while left.any():
        m = np.flatnonzero(left)[degree[left].argmax()]
        take = near[m] & left
        take[m] = True
        medoid[take], left[take] = ids[m], False
    return medoid


def _split_small(radius: float):
    """One loose component to clusters."""

    def split(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"id": ids, "cluster": _medoids(ids, np.vstack(rows["f"].to_numpy()), radius)})

    return split


def _degree_block(radius: float):
    def count(_, rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["own"].to_numpy()
        x, y = np.vstack(rows["f"].to_numpy()[mine]) if mine.any() else None, np.vstack(rows["f"].to_numpy()[~mine]) if (~mine).any() else None
        if x is None or y is None:
            return pd.DataFrame({"id": np.zeros(0, np.int64), "degree": np.zeros(0, np.int64)})
        d = np.concatenate([((x[k : k + 200, None, :] - y[None]) ** 2).sum(axis=2).__le__(radius**2).sum(axis=1) for k in range(0, len(x), 200)])
        return pd.DataFrame({"id": rows["id"].to_numpy()[mine], "degree": d})

    return count


def _split_large(members: DataFrame, radius: float, ws: Workspace) -> DataFrame:
    """The same for components too large for one task: degrees over block pairs, then a medoid for each component in every turn."""
    parts = members.groupBy("group_id").agg(F.ceil(F.count("*") / LOOSE_ROWS).cast("int").alias("m"))
    at = members.join(parts, "group_id").withColumn("mine", F.pmod(F.xxhash64("id"), "m").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    units = at.select("group_id", "id", "f", F.lit(True).alias("own"), F.col("mine").alias("i"), other.alias("j")).unionByName(at.select("group_id", "id", "f", F.lit(False).alias("own"), other.alias("i"), F.col("mine").alias("j")))
    degree = units.groupBy("group_id", "i", "j").applyInPandas(_degree_block(radius), "id long, degree long").groupBy("id").agg(F.sum("degree").alias("degree"))
    left = ws.keep(members.join(degree, "id"), "loose")
    out = []
    while not left.isEmpty():
        top = left.groupBy("group_id").agg(F.max(F.struct("degree", -F.col("id"), "f")).alias("t")).select("group_id", (-F.col("t").getField("col2")).alias("cluster"), F.col("t.f").alias("c"))
        d = F.aggregate(F.zip_with("f", "c", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e)
        turn = ws.keep(left.join(top, "group_id").withColumn("in", (d <= radius**2) | (F.col("id") == F.col("cluster"))), "turn")
        out.append(turn.where("in").select("id", "cluster"))
        left = turn.where("NOT in").select("group_id", "id", "f", "degree")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


class Leaves:
    """Space cut into units by a sample (ids, x) of the rows, ``per_row`` sampled rows for each row.

    A leaf above ``rows`` rows is cut where few sampled rows are within ``radius`` of the plane. One that stays above ``most`` is dense: it has
    stars, each a pivot of the sample whose neighbours are spread over several units (where visitors don't outnumber them), and what the stars
    leave, which is a unit, or, if that too is above ``most``, for the shuffled bands (unit -1).
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, per_row: float, rows: float, most: float, radius: float):
        self.radius, self.reach = radius, radius * (1 + 1e-9)
        self.at, self.cut, self.below, self.above = [], [], [], []  # below and above: a node, or ~leaf
        self.unit: list[int] = []  # of each leaf
        self.stars: list[list[int]] = []  # of each leaf, in the order in which they take records
        self.pid, self.pivot, self.first, self.count = [], [], [], []  # of each star: its record, its units
        self.units, self.banded = 0, False
        todo, self.root = [(np.arange(len(x)), None, False)], 0
        while todo:
            own, parent, upper = todo.pop()
            n = len(own) / per_row
            plane = self._plane(x[own], 0.05 if n <= most else 0.15) if n > rows else None
            if plane is None:
                place = ~len(self.unit)
                self._leaf(ids[own], x[own], per_row, most)
            else:
                d, c = plane
                place = len(self.at)
                self.at.append(d)
                self.cut.append(c)
                self.below.append(0)
                self.above.append(0)
                todo += [(own[x[own, d] < c], place, False), (own[x[own, d] >= self._low(c)], place, True)]
            if parent is None:
                self.root = place
            else:
                (self.above if upper else self.below)[parent] = place
        self.at, self.below, self.above, self.unit = (np.array(v, dtype=np.int64) for v in (self.at, self.below, self.above, self.unit))
        self.cut = np.array(self.cut, dtype=np.float64)

    def _low(self, cut):
        """Where the records above a plane begin that go to both sides of it, with room for rounding."""
        return cut - self.reach - 1e-12 * np.abs(cut)

    def _plane(self, x: np.ndarray, share: float) -> tuple[int, float] | None:
        """The plane with fewest rows within reach below it, if these are at most ``share`` of all."""
        n, best = len(x), None
        if n < 20:
            return None
        for d in range(x.shape[1]):
            v = np.sort(x[:, d])
            c = v[n // 5 : n - n // 5]
            c = c[:: max(1, len(c) // 500)]
            left = np.searchsorted(v, c)
            twice = left - np.searchsorted(v, self._low(c))
            cost = twice / n + 0.05 * np.abs(left / n - 0.5)
            cost[(twice > share * n) | (left < n // 5) | (left - twice < n // 10)] = np.inf
            k = cost.argmin()
            if cost[k] < np.inf and (best is None or cost[k] < best[0]):
                best = cost[k], d, float(c[k])
        return best and best[1:]

    def _leaf(self, ids: np.ndarray, x: np.ndarray, per_row: float, most: float) -> None:
        stars, left, n = [], np.ones(len(x), dtype=bool), len(x)
        some = np.arange(n)[:: max(1, n // 2000)]
        near, able = None, np.ones(len(some), dtype=bool)
        while left.sum() / per_row > most and able.any():
            if near is None:
                near = np.concatenate([((x[some[k : k + 100], None] - x[None, some]) ** 2).sum(axis=2) <= self.radius**2 for k in range(0, len(some), 100)])
            k = np.where(able, (near & left[some]).sum(axis=1), -1).argmax()
            able &= ~near[k]
            d = ((x - x[some[k]]) ** 2).sum(axis=1)
            took = left & (d <= self.radius**2)
            units = max(1, int(np.ceil(2 * took.sum() / per_row / most)))
            if took.sum() < 0.02 * n:
                break
            if units * (~took & (d <= 4 * self.radius**2)).sum() > took.sum():
                continue  # more visits than records
            stars.append(len(self.pid))
            self.pid.append(int(ids[some[k]]))
            self.pivot.append(x[some[k]])
            self.first.append(self.units)
            self.count.append(units)
            self.units += units
            left &= ~took
        self.stars.append(stars)
        if left.sum() / per_row > most:
            self.banded = True
            self.unit.append(-1)
        else:
            self.unit.append(self.units)
            self.units += 1

    def route(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, unit, home, star and copied of each place that a record goes to. home: one place of each record; star: the star that it belongs to, -1
        for none, and -2 - star where it is a visitor; copied: it goes to other places too."""
        row, node, home = np.arange(len(x)), np.full(len(x), self.root), np.ones(len(x), dtype=bool)
        while (inner := node >= 0).any():
            i = np.flatnonzero(inner)
            v, c = x[row[i], self.at[node[i]]], self.cut[node[i]]
            below, above = v < c, v >= self._low(c)
            both = below & above
            more = self.above[node[i[both]]]
            node[i] = np.where(below, self.below[node[i]], self.above[node[i]])
            row, node, home = np.r_[row, row[i[both]]], np.r_[node, more], np.r_[home, np.zeros(len(more), dtype=bool)]
        leaf = ~node
        unit, star = self.unit[leaf], np.full(len(row), -1)
        guests = []
        for of in np.unique(leaf):
            if not self.stars[of]:
                continue
            here = np.flatnonzero(leaf == of)
            d = np.stack([((x[row[here]] - self.pivot[s]) ** 2).sum(axis=1) for s in self.stars[of]], axis=1)
            taken = d <= self.radius**2
            own = np.where(taken.any(axis=1), taken.argmax(axis=1), -1)
            for k, s in enumerate(self.stars[of]):
                mine = here[own == k]
                star[mine] = s
                unit[mine] = self.first[s] + _mix(ids[row[mine]].astype(np.uint64) * _MIX) % np.uint64(self.count[s])
                visit = here[(own != k) & (d[:, k] <= (2 * self.reach) ** 2)]
                guests.append((np.repeat(row[visit], self.count[s]), np.tile(np.arange(self.count[s]) + self.first[s], len(visit)), s))
        for r, u, s in guests:
            row, unit, home, star = np.r_[row, r], np.r_[unit, u], np.r_[home, np.zeros(len(r), dtype=bool)], np.r_[star, np.full(len(r), -2 - s)]
        return row, unit, home, star, np.bincount(row, minlength=len(x))[row] > 1


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float64)
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _unbinary(v: pa.Array, dim: int) -> np.ndarray:
    if not len(v):
        return np.zeros((0, dim))
    ends = np.frombuffer(v.buffers()[1], dtype=np.int32)[v.offset : v.offset + len(v) + 1]
    return np.frombuffer(v.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].copy().view(np.float64).reshape(-1, dim)


ROUTED = "unit int, id long, v binary, home boolean, star int, copied boolean"


def _routing(leaves: Leaves, dim: int, banded: bool):
    """Records (id, f) to places in units, or to those that are left to the bands."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            row, unit, home, star, copied = leaves.route(ids, x)
            if leaves.banded:
                keep = np.flatnonzero((unit < 0) == banded)
                row, unit, home, star, copied = row[keep], unit[keep], home[keep], star[keep], copied[keep]
            columns = [pa.array(unit.astype(np.int32)), pa.array(ids[row]), _binary(x[row]), pa.array(home), pa.array(star.astype(np.int32)), pa.array(copied)]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "id", "v", "home", "star", "copied"])

    return route


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after the links (a, b), each named by its least place, as ``label`` has them before."""
    label = label.copy()
    while True:
        p, q = label[a], label[b]
        new = p != q
        if not new.any():
            return label
        a, b, p, q = a[new], b[new], p[new], q[new]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _across(linked, x: np.ndarray, rows: np.ndarray, others: np.ndarray, start: np.ndarray, n: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``rows`` one link to one of its ``n`` others from ``start`` on, if there is any. Where there are many pairs, only those are
    looked at whose places on the line between both sides' means are within ``reach``."""
    lo, hi, others = start.copy(), start + n, others.copy()
    sets = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (n[1:] != n[:-1])]) if len(rows) else np.zeros(0, int)
    for s, e in zip(sets, np.r_[sets[1:], len(rows)]):
        if n[s] * (e - s) > PAIRS // 10:
            mine, theirs = x[rows[s:e]], others[start[s] : start[s] + n[s]]
            line = x[theirs].mean(axis=0) - mine.mean(axis=0)
            line = line / length if (length := np.sqrt((line**2).sum())) > 0 else np.eye(len(line))[0]
            place = x[theirs] @ line
            order = np.argsort(place, kind="stable")
            others[start[s] : start[s] + n[s]], place, at = theirs[order], place[order], mine @ line
            room = reach * (1 + 1e-6) + 1e-9 * np.abs(at)
            lo[s:e], hi[s:e] = start[s] + np.searchsorted(place, at - room), start[s] + np.searchsorted(place, at + room, side="right")
    a, b, step, left = [rows[:0]], [rows[:0]], 64, np.flatnonzero(lo < hi)
    while len(left):
        m = np.minimum(hi[left] - lo[left], step)
        found = np.zeros(len(left), dtype=bool)
        for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(m) // PAIRS)) + 1):
            of = np.repeat(part, m[part])
            to = others[np.repeat(lo[left[part]], m[part]) + np.arange(m[part].sum()) - np.repeat(np.cumsum(m[part]) - m[part], m[part])]
            hit = np.flatnonzero(linked(rows[left[of]], to))
            one, where = np.unique(of[hit], return_index=True)
            found[one] = True
            a.append(rows[left[one]])
            b.append(to[hit[where]])
        lo[left] += m
        left = left[~found & (lo[left] < hi[left])]
        step = min(4 * step, PAIRS)
    return np.concatenate(a), np.concatenate(b)


def _linked(check: Verifier, x: np.ndarray):
    at = check.lattice(x)

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            near = np.flatnonzero(check.jaccard(at[p], at[q]) >= check.least)
            out[k + near] = ((x[p[near]] - x[q[near]]) ** 2).sum(axis=1) <= check.radius**2
        return out

    return linked


def _components(check: Verifier, x: np.ndarray) -> np.ndarray:
    """The least place of each row's component, by one band after the other; rows that are joined already aren't verified again."""
    linked, label = _linked(check, x), np.arange(len(x))
    keys = np.concatenate([band_keys(x[k : k + 2000], check.width, check.shifts) for k in range(0, len(x), 2000)]) if len(x) else np.zeros((0, BANDS), np.int64)
    for band in range(keys.shape[1]):
        left = np.argsort(keys[:, band], kind="stable")
        key = keys[left, band]
        first = np.r_[True, key[1:] != key[:-1]]
        bucket = np.cumsum(first) - 1
        apart = np.bincount(bucket, label[left] != label[left[first]][bucket]) > 0
        left, bk = left[apart[bucket]], bucket[apart[bucket]]
        a, b = [left[:0]], [left[:0]]
        while len(left):
            # the rows left against their bucket's first one, those that fail against the ones joined with it, and those go into the next turn
            first = np.r_[0, np.flatnonzero(bk[1:] != bk[:-1]) + 1]
            size = np.diff(np.r_[first, len(left)])
            pivot = np.repeat(left[first], size)
            ok = label[left] == label[pivot]
            new = np.flatnonzero(~ok)
            new = new[linked(left[new], pivot[new])]
            ok[new] = True
            a.append(left[new])
            b.append(pivot[new])
            d = np.sqrt(((x[left] - x[pivot]) ** 2).sum(axis=1))
            far = np.maximum.reduceat(np.where(ok, d, 0.0), first)
            good, failed = left[ok], np.flatnonzero(~ok)
            # a row is linked with none if it is further from the pivot than any of them and the radius
            close = failed[d[failed] <= (np.repeat(far, size)[failed] + check.radius) * (1 + 1e-9)]
            start = np.searchsorted(bk[ok], bk[close], side="left")
            n = np.searchsorted(bk[ok], bk[close], side="right") - start
            p, q = _across(linked, x, left[close], good, start, n, check.radius)
            a.append(p)
            b.append(q)
            left, bk = left[failed], bk[failed]
        label = _joined(label, np.concatenate(a), np.concatenate(b))
    return label


def _middle(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows by label, where each one's rows begin, their number, and the squared distance to their mean in that order."""
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
    size = np.diff(np.r_[first, len(label)])
    mean = np.add.reduceat(x[order], first, axis=0) / size[:, None]
    return order, first, size, ((x[order] - np.repeat(mean, size, axis=0)) ** 2).sum(axis=1)


def _clusters_in(ids: np.ndarray, x: np.ndarray, label: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster_min, cluster_size and to_centre of rows in whole components, sorted by id, and whether they are left to others: the component is
    loose and too large to be split here."""
    none = np.zeros(len(ids), dtype=bool)
    if not len(ids):
        return ids, ids, np.zeros(0), none
    order, first, size, d = _middle(x, label)
    group = np.repeat(np.arange(len(first)), size)
    typical = order[np.lexsort((order, d, group))[first]]
    far = np.maximum.reduceat(((x[order] - x[np.repeat(typical, size)]) ** 2).sum(axis=1), first)
    cluster, large = label.copy(), none
    for k in np.flatnonzero(far > radius**2):
        rows = order[first[k] : first[k] + size[k]]
        if size[k] > LOOSE_ROWS:
            large[rows] = True
        else:
            cluster[rows] = _medoids(rows, x[rows], radius)
    if (cluster != label).any():
        order, first, size, d = _middle(x, cluster)
    least, n, centre = np.empty_like(ids), np.empty(len(ids), dtype=np.int64), np.empty(len(ids))
    least[order], n[order], centre[order] = np.repeat(np.minimum.reduceat(ids[order], first), size), np.repeat(size, size), np.sqrt(d)
    return least, n, centre, large


FOUND = "id long, cluster_min long, cluster_size long, to_centre double, link long, v binary"


def _search(check: Verifier, stars: list[int]):
    """Units to their records: with their cluster, or with a link of their component and, at home, with their vector. ``stars``: the pivots' ids."""

    def unit(ids: np.ndarray, x: np.ndarray, home: np.ndarray, star: np.ndarray, copied: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, x, home, star, copied = ids[order], x[order], home[order], star[order], copied[order]
        if (star != -1).any():
            pid = stars[max(star.max(), (-2 - star).max())]
            own, guest = np.flatnonzero(star >= 0), np.flatnonzero(star < -1)
            p, _ = _across(_linked(check, x), x, guest, own, np.zeros(len(guest), int), np.full(len(guest), len(own)), check.radius)
            link, open = np.full(len(ids), pid), star >= 0
            open[p] = True
            done, out = np.zeros(len(ids), dtype=bool), (ids, ids, np.zeros(len(ids)))
        else:
            label = _components(check, x)
            shared = np.zeros(len(ids), dtype=bool)
            shared[label[copied]] = True
            open, link = shared[label], ids[label]
            done = ~open
            out, at = [np.zeros(len(ids), dtype=t) for t in (np.int64, np.int64, np.float64)], np.flatnonzero(done)
            *parts, large = _clusters_in(ids[at], x[at], label[at], check.radius)
            for to, part in zip(out, parts):
                to[at] = part
            done[at[large]], open[at[large]] = False, True
        rows = np.flatnonzero(done | home | (open & (link != ids)))
        vector = np.flatnonzero((home & ~done)[rows])
        ends = np.zeros(len(rows) + 1, dtype=np.int32)
        ends[1:][vector] = x.shape[1] * 8
        data = np.ascontiguousarray(x[rows[vector]])
        valid = np.packbits((home & ~done)[rows], bitorder="little")
        v = pa.Array.from_buffers(pa.binary(), len(rows), [pa.py_buffer(valid), pa.py_buffer(np.cumsum(ends, dtype=np.int32)), pa.py_buffer(data)])
        no = ~done[rows]
        columns = [pa.array(ids[rows]), *(pa.array(o[rows], mask=no) for o in out), pa.array(link[rows], mask=~(open & (link != ids))[rows]), v]
        return pa.RecordBatch.from_arrays(columns, names=["id", "cluster_min", "cluster_size", "to_centre", "link", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[], [], [], [], [], []]
        for batch in batches:
            for to, name in zip(held, ("unit", "id", "home", "star", "copied")):
                to.append(batch.column(name).to_numpy(zero_copy_only=False))
            held[5].append(_unbinary(batch.column("v"), check.dim))
        if not held[0]:
            return
        units, ids, home, star, copied, x = (np.concatenate(held.pop(0)) for _ in range(6))
        if (units == units[0]).all():
            out = unit(ids, x, home, star, copied)
            yield from (out.slice(k, 50_000) for k in range(0, len(out), 50_000))
            return
        order = np.argsort(units, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(units[order])) + 1):
            yield unit(ids[rows], x[rows], home[rows], star[rows], copied[rows])

    return search


def similarity_clusters(df: DataFrame, *, dim: int, radius: float, id: str = "index_train", features: str = "features", hot_rows: int = HOT_ROWS, leaf_rows: int | None = None, most_rows: int | None = None) -> DataFrame:
    """One row for each usable record: id, cluster_min, cluster_size, to_centre.

    Records are usable if their id is not null and their features have ``dim`` elements, none null, NaN or infinite; an id that occurs
    several times counts once. Records linked directly or through others (distance up to ``radius``) are one group; a group whose
    members aren't all within ``radius`` of its most typical one is loose and split around the members with most links. cluster_min is
    the least id of the cluster, and to_centre the distance to the mean of its members. A lone record is a cluster of one. An empty
    table gives no rows. ``leaf_rows`` and ``most_rows``: a leaf is cut above the one and goes to several tasks above the other; by default
    they follow from the rows and shuffle partitions, and from LEAF_BYTES.
    """
    spark = df.sparkSession
    ws = Workspace(spark)
    records = ws.keep(_once(df, id, features, dim), "records")
    count, n = records.count(), shuffle_partitions(spark)
    if not count:
        return records.selectExpr(f"id AS `{id}`", "id AS cluster_min", "1L AS cluster_size", "0D AS to_centre")
    part = min(1.0, 1.02 * SAMPLE_ROWS / count)
    picked = records.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1_000_000)) < int(np.ceil(part * 1_000_000))).limit(SAMPLE_ROWS).toPandas().sort_values("id")
    sample = np.vstack(picked["f"].to_numpy()) if len(picked) else np.zeros((0, dim))
    rows, most = leaf_rows or max(LEAF_ROWS, count / (2 * n)), most_rows or LEAF_BYTES / (8 * dim)
    leaves = Leaves(picked["id"].to_numpy(), sample, len(sample) / count or 1.0, rows, max(rows, most), radius)
    check = Verifier(dim, radius, WIDTH * radius, max(4, ELEMENTS // dim))
    routed = records.mapInArrow(_routing(leaves, dim, False), ROUTED)
    found = ws.keep(routed.repartitionById(max(1, leaves.units), F.col("unit")).mapInArrow(_search(check, leaves.pid), FOUND), "found")
    done = found.where("cluster_min IS NOT NULL").select(F.col("id").alias(id), "cluster_min", "cluster_size", "to_centre")
    vectors, links = found.where("v IS NOT NULL").select("id", "v"), found.where("link IS NOT NULL").select(F.col("id").alias("a"), F.col("link").alias("b"))
    if leaves.banded:
        crowd = ws.keep(records.mapInArrow(_routing(leaves, dim, True), ROUTED), "crowd")
        vectors = vectors.unionByName(crowd.where("home").select("id", "v"))
        links = links.unionByName(similar_links(crowd.select("id", "v"), dim, radius, hot_rows=hot_rows))
    if vectors.isEmpty():
        return done
    records = ws.keep(vectors.mapInArrow(_vectors(dim), "id long, f array<double>"), "open")
    groups = consolidate(links, "a", "b")
    members = ws.keep(records.join(groups, "id"), "members")
    described = _centred(members, "group_id", dim)
    typical = described.groupBy("group_id").agg(F.min_by("f", F.struct("to_centre", "id")).alias("c"))
    d = F.aggregate(F.zip_with("f", "c", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e)
    loose = members.join(typical, "group_id").groupBy("group_id").agg(F.max(d).alias("far"), F.count("*").alias("n")).where(F.col("far") > radius**2)
    loose = ws.keep(loose.select("group_id", "n"), "loose")
    final = members.select("id", "f", F.col("group_id").alias("cluster"))
    if not loose.isEmpty():
        small = members.join(loose.where(F.col("n") <= LOOSE_ROWS), "group_id").select("group_id", "id", "f")
        split = small.groupBy("group_id").applyInPandas(_split_small(radius), "id long, cluster long")
        large = members.join(loose.where(F.col("n") > LOOSE_ROWS), "group_id").select("group_id", "id", "f")
        if not large.isEmpty():
            split = split.unionByName(_split_large(large, radius, ws))
        split = ws.keep(split, "split")
        tight = members.join(loose, "group_id", "left_anti").select("id", F.col("group_id").alias("cluster"))
        final = records.join(tight.unionByName(split), "id").select("id", "f", "cluster")
    final = ws.keep(final, "final")
    sizes = final.groupBy("cluster").agg(F.min("id").alias("cluster_min"), F.count("*").alias("cluster_size"))
    out = _centred(final, "cluster", dim).join(sizes, "cluster").select("id", "cluster_min", "cluster_size", "to_centre")
    lone = records.join(final, "id", "left_anti").select("id", F.col("id").alias("cluster_min"), F.lit(1).cast("long").alias("cluster_size"), F.lit(0.0).alias("to_centre"))
    return done.unionByName(out.unionByName(lone).withColumnRenamed("id", id))


def _vectors(dim: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unbinary(batch.column("v"), dim)
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(dim)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), f], names=["id", "f"])

    return read


def _centred(members: DataFrame, group: str, dim: int) -> DataFrame:
    """Adds to_centre, the distance to the mean of the group; the means are summed before the shuffle."""
    centre = members.groupBy(group).agg(F.array(*(F.avg(F.get("f", F.lit(k))) for k in range(dim))).alias("mean"))
    d = F.aggregate(F.zip_with("f", "mean", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e)
    return members.join(centre, group).withColumn("to_centre", F.sqrt(d)).drop("mean")


def describe_clusters(clusters: DataFrame, id: str = "index_train", typical: int = 3, at_least: int = 2) -> DataFrame:
    """(cluster_min, cluster_size, typical): the ``typical`` members nearest to the cluster's centre, nearest first, ties to the smaller id."""
    w = Window.partitionBy("cluster_min").orderBy("to_centre", id)
    best = clusters.where(F.col("cluster_size") >= at_least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    return best.groupBy("cluster_min", "cluster_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(id).alias("member")))), lambda s: s["member"]).alias("typical"))
