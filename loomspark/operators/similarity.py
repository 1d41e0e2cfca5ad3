"""The matrix of pairwise distances, strict upper triangle, and its normalisation by degree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.distance import CELLS, check_metric, own_blocks, pack, pairwise
from loomspark.operators.knn import with_id


def unit_pairs(unit: pd.DataFrame, metric: str, most: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lesser id, greater id, distance) of a unit's pairs, some rows at a time. With a column w the distance is scaled by 2 * min(w) / (w + w)."""
    own, within = unit["own"].to_numpy(), unit["i"].iloc[0] == unit["j"].iloc[0]
    a, b = unit[own], unit if within else unit[~own]
    if not len(a) or not len(b):
        return
    x, y, ia, ib = np.vstack(a["f"].to_numpy()), np.vstack(b["f"].to_numpy()), a["id"].to_numpy(), b["id"].to_numpy()
    step = max(1, CELLS // len(y))
    for s in range(0, len(x), step):
        d = pairwise(x[s : s + step], y, metric)
        if "w" in unit:
            wa, wb = a["w"].to_numpy()[s : s + step, None], b["w"].to_numpy()[None]
            d = d * 2 * np.minimum(wa, wb) / (wa + wb)
        keep = ia[s : s + step, None] < ib[None] if within else ia[s : s + step, None] != ib[None]
        if most is not None:
            keep &= d <= most
        i, j = np.nonzero(keep)
        p, q = ia[s + i], ib[j]
        turned = p > q
        yield np.where(turned, q, p), np.where(turned, p, q), d[i, j]


class SimilarityMatrix:
    """``SimilarityMatrix(df).prep().create_sim_matrix()``."""

    def __init__(self, df: DataFrame):
        self.df, self.packed, self.matrix = df, None, None

    def prep(self, window_size: int | None = None, idcol: str = "id", features: list[str] | None = None) -> SimilarityMatrix:
        self.id = idcol
        rows = with_id(self.df, idcol)
        self.id_type = rows.schema[idcol].dataType.simpleString()
        self.packed = pack(rows, idcol, features or [c for c in rows.columns if c != idcol])
        return self

    @classmethod
    def of_arrays(cls, df: DataFrame, idcol: str, features: str) -> SimilarityMatrix:
        """The same for a table that has its features in one array column."""
        out = cls(df)
        out.id, out.id_type = idcol, df.schema[idcol].dataType.simpleString()
        out.packed = df.select(F.col(idcol).alias("id"), F.col(features).cast("array<double>").alias("f"))
        return out

    def create_sim_matrix(self, metric: str = "euclidean", most: float | None = None, block_rows: int | None = None) -> DataFrame:
        """(<id>_A, <id>_B, distance) with A < B; only pairs up to ``most`` apart, if given. Rows with null or NaN features are in none."""
        check_metric(metric)
        if self.packed is None:
            raise ValueError("prep comes first")
        rows = self.packed.where(F.col("id").isNotNull() & ~F.exists("f", lambda x: x.isNull() | F.isnan(x)))

        def pairs(_, unit: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"a": a, "b": b, "distance": d}) for a, b, d in unit_pairs(unit, metric, most)]
            return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"a": unit["id"].iloc[:0], "b": unit["id"].iloc[:0], "distance": np.zeros(0)})

        found = own_blocks(rows, block_rows).groupBy("i", "j").applyInPandas(pairs, f"a {self.id_type}, b {self.id_type}, distance double")
        self.matrix = found.select(F.col("a").alias(f"{self.id}_A"), F.col("b").alias(f"{self.id}_B"), "distance")
        return self.matrix

    def create_degree_matrix(self, treshold: float = 0.3) -> DataFrame:
        """Pairs with distance >= treshold, the distance divided by the root of both ends' sums (the column is read as a similarity)."""
        if self.matrix is None:
            raise ValueError("create_sim_matrix comes first")
        return degree_normalized(self.matrix, self.id, treshold)


def degree_normalized(matrix: DataFrame, id: str, treshold: float = 0.3) -> DataFrame:
    a, b = f"{id}_A", f"{id}_B"
    kept = matrix.where(F.col("distance") >= treshold)
    degree = degrees(kept, id)
    return (
        kept.join(degree.select(F.col("node").alias(a), F.col("degree").alias("da")), a)
        .join(degree.select(F.col("node").alias(b), F.col("degree").alias("db")), b)
        .select(a, b, (F.col("distance") * F.col("da") * F.col("db")).alias("distance"))
    )


def degrees(matrix: DataFrame, id: str) -> DataFrame:
    """(node, degree): one over the root of the sum of a node's distances; null where that is 0."""
    ends = matrix.select(F.explode(F.array(f"{id}_A", f"{id}_B")).alias("node"), "distance")
    return ends.groupBy("node").agg(F.try_divide(F.lit(1.0), F.sqrt(F.sum("distance"))).alias("degree"))
