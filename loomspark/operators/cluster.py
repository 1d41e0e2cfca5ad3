"""Agglomerative clustering in rounds: close pairs, their connected components, centroids, and again."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.distance import check_metric, l2_normalized, own_blocks, pack
from loomspark.graph.algorithms import components_of
from loomspark.operators.knn import with_id
from loomspark.operators.similarity import unit_pairs
from loomspark.session import shared_dir


class HiClust:
    """``HiClust(df).fit().get_clusters()``; each level maps the clusters of the one before to new ones."""

    def __init__(self, df: DataFrame, idcol: str = "index_train", features: list[str] | None = None):
        self.id = idcol
        self.df = with_id(df, idcol)
        self.features = features or [c for c in self.df.columns if c != idcol]
        self.levels: list[DataFrame] = []
        self.fitted = False

    def fit(self, metric: str = "euclidean", distance_threshold: float = 0.1, max_iterations: int = 10, auto_threshold: bool = False, find_top_one: bool = False, weighted_centroids: bool = False) -> HiClust:
        """Merge what is up to ``distance_threshold`` apart until nothing merges.

        A pair's distance is scaled by 2 * min(w) / (w + w) of the clusters' sizes. ``auto_threshold`` lowers the threshold to the mean
        plus three standard deviations of all such distances, ``find_top_one`` merges only mutual nearest ones (ties to the least id),
        ``weighted_centroids`` weighs centroids by size.
        """
        check_metric(metric)
        shared_dir(self.df.sparkSession)
        rows = pack(self.df, self.id, self.features).where(F.col("id").isNotNull() & ~F.exists("f", lambda x: x.isNull() | F.isnan(x)))
        if metric == "cosine":
            rows = rows.withColumn("f", l2_normalized("f"))
        now = rows.withColumn("w", F.lit(1.0)).checkpoint()
        kind, count, self.levels = now.schema["id"].dataType, now.count(), []
        for _ in range(max_iterations):
            close = self._close(now, metric, distance_threshold, auto_threshold, find_top_one)
            found = components_of(close.select("a", "b"))
            mapping = now.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").cast(kind).alias("component")).checkpoint()
            merged = mapping.select("component").distinct().count()
            if merged == count:
                break
            dim = len(self.features)
            mean = (lambda k: F.sum(F.get("f", F.lit(k)) * F.col("w")) / F.sum("w")) if weighted_centroids else (lambda k: F.avg(F.get("f", F.lit(k))))
            now = now.join(mapping, "id").groupBy(F.col("component").alias("id")).agg(F.array(*map(mean, range(dim))).alias("f"), F.sum("w").alias("w")).checkpoint()
            self.levels.append(mapping)
            count = merged
        self.centroids = now.select(F.col("id").alias(f"cluster_id_{len(self.levels)}"), *(F.get("f", F.lit(k)).alias(c) for k, c in enumerate(self.features)), F.col("w").alias("dist_weight"))
        self.fitted = True
        return self

    def _close(self, now: DataFrame, metric: str, threshold: float, auto: bool, mutual: bool, block_rows: int | None = None) -> DataFrame:
        """Pairs up to the threshold. Weights are scaled and pairs cut where the distances are worked out; no other pair leaves its task."""
        kind = now.schema["id"].dataType.simpleString()
        units = own_blocks(now.select("id", "f", "w"), block_rows).groupBy("i", "j")

        def sums(_, unit: pd.DataFrame) -> pd.DataFrame:
            parts = [(len(d), d.sum(), (d * d).sum()) for _, _, d in unit_pairs(unit, metric, None)]
            return pd.DataFrame([[float(sum(x)) for x in zip(*parts)] if parts else [0.0, 0.0, 0.0]], columns=["n", "s", "q"])

        if auto:
            n, s, q = units.applyInPandas(sums, "n double, s double, q double").agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
            if n and n > 1:
                threshold = min(threshold, s / n + 3 * math.sqrt(max(0.0, (q - s * s / n) / (n - 1))))
        cut = threshold

        def pairs(_, unit: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"a": a, "b": b, "distance": d}) for a, b, d in unit_pairs(unit, metric, cut)]
            return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"a": unit["id"].iloc[:0], "b": unit["id"].iloc[:0], "distance": np.zeros(0)})

        close = units.applyInPandas(pairs, f"a {kind}, b {kind}, distance double")
        if mutual:
            both = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
            best = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where("r = 1").select("a", "b", "distance")
            close = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b")
        return close.checkpoint()

    def combine_cluster_iterations(self) -> DataFrame:
        """(id, cluster_id_0, …): every row's cluster at each level, named by its least member's id; a row that a level leaves alone keeps its cluster."""
        if not self.fitted:
            raise ValueError("fit comes first")
        out = self.df.select(self.id).withColumn("raw", F.col(self.id)).withColumn("cluster_id_0", F.col(self.id))
        for k, mapping in enumerate(self.levels, 1):
            out = out.join(mapping.withColumnRenamed("id", "raw"), "raw", "left")
            out = out.withColumn("raw", F.coalesce("component", "raw")).withColumn(f"cluster_id_{k}", F.col("raw")).drop("component")
        return out.drop("raw")

    def get_clusters(self, iteration: int | None = None) -> DataFrame:
        """(id, cluster) of one level, by default the last; a level beyond it gives the last."""
        history = self.combine_cluster_iterations()
        k = len(self.levels) if iteration is None else min(iteration, len(self.levels))
        return history.select(self.id, F.col(f"cluster_id_{k}").alias("cluster"))
