"""Distances between array columns as JVM expressions, and the block kernel for many pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import shuffle_partitions

METRICS = ("euclidean", "manhattan", "cosine")
#: Bytes of one side of a block, and distances worked out at once.
BLOCK_BYTES = 64 * 1024 * 1024
CELLS = 4_000_000
#: Rows below which a side isn't cut only to occupy more tasks.
LEAST_ROWS = 500


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise AssertionError(f"metric must be one of {METRICS}, not {metric!r}")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column | str, b: Column | str, metric: str = "euclidean") -> Column:
    """Distance of two arrays of doubles. Null if an element is; the cosine distance of a zero vector is null."""
    check_metric(metric)
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "manhattan":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return 1.0 - F.try_divide(dot, norms)


def l2_normalized(a: Column | str) -> Column:
    """The array scaled to unit length; a zero vector stays as it is."""
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x)))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def pairwise(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """All distances of the rows of x to the rows of y."""
    if metric == "manhattan":
        return np.concatenate([np.abs(x[s : s + 64, None, :] - y[None]).sum(axis=2) for s in range(0, len(x), 64)]) if len(x) else np.zeros((0, len(y)))
    if metric == "cosine":
        norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
        return 1.0 - np.divide(x @ y.T, norms, out=np.full(norms.shape, np.nan), where=norms > 0)
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T)
    near = np.argwhere(d < 1e-6 * ((x * x).sum(axis=1)[:, None] + 1e-300))  # cancellation: worked out anew
    if len(near):
        i, j = near.T
        d[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0.0))


def pack(df: DataFrame, id: str, features: list[str]) -> DataFrame:
    """(id, f): the named numeric columns, in that order, as one array of doubles."""
    return df.select(F.col(f"`{id}`").alias("id"), F.array(*(F.col(f"`{c}`").cast("double") for c in features)).alias("f"))


def block_counts(left: int, right: int, dim: int, tasks: int, rows: int | None = None) -> tuple[int, int]:
    """Into how many blocks the two sides are cut. A block fits BLOCK_BYTES (or has ``rows``), so the smaller side is in as few as possible and
    the larger one is copied as seldom; the larger side is cut further until there is a unit for every task."""
    rows = rows or max(LEAST_ROWS, BLOCK_BYTES // (8 * max(1, dim)))
    nl, nr = max(1, -(-left // rows)), max(1, -(-right // rows))
    most = max(1, max(left, right) // min(LEAST_ROWS, rows))
    if left >= right:
        return max(nl, min(most, -(-tasks // nr))), nr
    return nl, max(nr, min(most, -(-tasks // nl)))


def _block(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _dim(df: DataFrame) -> int:
    first = df.select(F.size("f")).first()
    return first[0] if first else 1


def blocks(left: DataFrame, right: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, f, own, i, j): both sides cut into blocks, each block of ``left`` (own) beside each of ``right``; a unit (i, j) is a task's."""
    nl, nr = block_counts(left.count(), right.count(), _dim(left), shuffle_partitions(left.sparkSession), rows)
    a = left.select("id", "f", F.lit(True).alias("own"), _block(nl).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("j"))
    b = right.select("id", "f", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(nl - 1))).alias("i"), _block(nr).alias("j"))
    return a.unionByName(b)


def own_blocks(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of ``df`` (id, f, ...) with own, i, j: blocks of one table beside each other, every two of them once (i <= j). own: whether
    the row is in block i; in units i = j all are."""
    tasks = shuffle_partitions(df.sparkSession)
    n, rows = df.count(), rows or max(LEAST_ROWS, BLOCK_BYTES // (8 * _dim(df)))
    m = max(1, -(-n // rows), min(n // min(LEAST_ROWS, rows), math.isqrt(2 * tasks)))
    at = df.withColumn("__b", _block(m)).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return at.withColumn("own", F.col("__b") <= F.col("__o")).withColumn("i", F.least("__b", "__o")).withColumn("j", F.greatest("__b", "__o")).drop("__b", "__o")


def nearest_in_blocks(left: DataFrame, right: DataFrame, k: int, metric: str, id_type: str, other_type: str, rows: int | None = None) -> DataFrame:
    """(id, other, distance): for each row of ``left`` the rows of ``right`` in a block that rank up to k there, ties kept."""

    def near(_, unit: pd.DataFrame) -> pd.DataFrame:
        own = unit["own"].to_numpy()
        a, b = unit[own], unit[~own]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"].iloc[:0], "other": b["id"].iloc[:0], "distance": np.zeros(0)})
        x, y, out = np.vstack(a["f"].to_numpy()), np.vstack(b["f"].to_numpy()), []
        step = max(1, CELLS // len(y))
        for s in range(0, len(x), step):
            d = pairwise(x[s : s + step], y, metric)
            d = np.where(np.isnan(d), np.inf, d)
            take = min(k, d.shape[1])
            cut = np.partition(d, take - 1, axis=1)[:, take - 1 : take]
            i, j = np.nonzero((d <= cut * (1 + 1e-12)) & (d < np.inf))
            out.append(pd.DataFrame({"id": a["id"].to_numpy()[s + i], "other": b["id"].to_numpy()[j], "distance": d[i, j]}))
        return pd.concat(out, ignore_index=True)

    return blocks(left, right, rows).groupBy("i", "j").applyInPandas(near, f"id {id_type}, other {other_type}, distance double")
