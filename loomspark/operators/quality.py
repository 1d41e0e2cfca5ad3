"""Clustering quality indices from each cluster's count, sums and sums of squares: one pass over the data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of the clusters' sums that a row is compared with at once; up to this size they are broadcast.
BLOCK_BYTES = 16 * 1024 * 1024


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class Indices:
    """wss, calinski_harabasz, wb_index, xu_index and silhouette of a clustering."""

    def __init__(self, features: list[str], cluster_col: str = "cluster"):
        self.features, self.cluster = features, cluster_col

    def _f(self):
        return F.array(*(F.col(c).cast("double") for c in self.features))

    def _packed(self, df: DataFrame) -> DataFrame:
        """(cluster, f): one array, as a filter on each of many columns makes the optimizer's constraints explode."""
        return df.select(self.cluster, self._f().alias("f")).where(F.col(self.cluster).isNotNull() & ~F.exists("f", lambda x: x.isNull()))

    def squares(self, df: DataFrame, centroids: DataFrame) -> DataFrame:
        """(cluster, n, wss, bss): for each cluster that has a centroid, its rows, their squared distances to it, and the centroid's share
        of the spread between clusters about the mean of all rows. Rows with a null cluster or feature count in none."""
        rows, c = self._packed(df), centroids.select(self.cluster, self._f().alias("c"))
        ks = [F.get("f", F.lit(k)) for k in range(len(self.features))]
        mean = rows.agg(F.array(*map(F.avg, ks)).alias("m"))
        # (x - c)^2 summed is xx - 2 c x + n c c, so only the sums are joined with the centroids
        sums = rows.groupBy(self.cluster).agg(F.count("*").alias("n"), F.array(*map(F.sum, ks)).alias("s"), F.sum(_dot("f", "f")).alias("q"))
        at = sums.join(c, self.cluster).join(F.broadcast(mean))
        wss = F.col("q") - 2 * _dot("c", "s") + F.col("n") * _dot("c", "c")
        apart = F.zip_with("c", "m", lambda x, y: x - y)
        return at.select(self.cluster, "n", F.greatest(wss, F.lit(0.0)).alias("wss"), (F.col("n") * _dot(apart, apart)).alias("bss"))

    def silhouette(self, df: DataFrame) -> DataFrame:
        """One row (silhouette): the mean over rows, by squared euclidean distance, from the clusters' sums."""
        rows = self._packed(df)
        ks = [F.get("f", F.lit(k)) for k in range(len(self.features))]
        sums = rows.groupBy(F.col(self.cluster).alias("c")).agg(F.count("*").alias("n"), F.array(*map(F.sum, ks)).alias("y"), F.sum(_dot("f", "f")).alias("p"))
        # the clusters are cut into blocks of BLOCK_BYTES; every row meets each block, and the least of the blocks counts
        n = max(1, -(-sums.count() * 8 * (len(self.features) + 3) // BLOCK_BYTES))
        every = sums.groupBy(F.pmod(F.xxhash64("c"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("c", "n", "y", "p")).alias("all"))
        at = rows.select(F.col(self.cluster).alias("own"), "f", _dot("f", "f").alias("xx")).withColumn("row", F.monotonically_increasing_id())
        at = at.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(F.broadcast(every) if n == 1 else every, "block")
        total = lambda s: F.col("xx") * s["n"] + s["p"] - 2.0 * _dot(F.col("f"), s["y"])
        mine = F.try_element_at(F.filter("all", lambda s: s["c"] == F.col("own")), F.lit(1))
        a = total(mine) / F.when(mine["n"] > 1, mine["n"] - 1)
        b = F.array_min(F.transform(F.filter("all", lambda s: s["c"] != F.col("own")), lambda s: total(s) / s["n"]))
        per = at.select("row", a.alias("a"), b.alias("b"), mine["n"].alias("n"))
        if n > 1:
            per = per.groupBy("row").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("n").alias("n"))
        return per.agg(F.avg(F.when(F.col("n") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)).alias("silhouette"))

    def balanced_sample(self, df: DataFrame, sample_size: int | None = None, sample_frac: float | None = None, seed: int = 42) -> DataFrame:
        """From every cluster about ``sample_size`` rows, or the part ``sample_frac``; the size wins; without either all rows."""
        if sample_size is None:
            return df if sample_frac is None else df.where(F.rand(seed) < sample_frac)
        sizes = df.groupBy(F.col(self.cluster).alias("__c")).agg((sample_size / F.count("*")).alias("__p"))
        return df.join(sizes, F.col(self.cluster) == F.col("__c")).where(F.rand(seed) < F.col("__p")).drop("__c", "__p")

    def compute_indices(self, df: DataFrame, centroids: DataFrame, num_clusters: int | None = None, sample_size: int | None = None, sample_frac: float | None = None, seed: int = 42) -> dict[str, float]:
        """All five; num_clusters defaults to the centroids'. With one cluster, or as many as rows, Calinski-Harabasz is 0."""
        t = self.squares(df, centroids).agg(F.sum("n"), F.sum("wss"), F.sum("bss")).first()
        n, wss, bss = t[0] or 0, t[1] or 0.0, t[2] or 0.0
        k = num_clusters or centroids.select(self.cluster).distinct().count()
        s = self.silhouette(self.balanced_sample(df, sample_size, sample_frac, seed)).first()[0]
        return {"wss": wss, "calinski_harabasz": calinski_harabasz(wss, bss, k, n), "wb_index": wss / bss if bss else math.inf, "xu_index": xu_index(wss, k, n), "silhouette": s}


def calinski_harabasz(wss: float, bss: float, k: int, n: int) -> float:
    if k <= 1 or n <= k:
        return 0.0
    return math.inf if wss == 0 else (bss / (k - 1)) / (wss / (n - k))


def xu_index(wss: float, k: int, n: int) -> float:
    return wss * math.log(k) / n + k * math.log(n) if k > 1 and n else 0.0
