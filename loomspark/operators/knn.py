"""k nearest neighbours: classification and regression by exact search in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.distance import check_metric, nearest_in_blocks, pack

CELLS = 0.3 * 2**20


def with_id(df: DataFrame, id: str) -> DataFrame:
    """The frame with an id column: its own, which must be unique, or a new one."""
    if id not in df.columns:
        return df.withColumn(id, F.monotonically_increasing_id())
    if not df.groupBy(id).count().where("count > 1").isEmpty():
        raise ValueError(f"{id} isn't unique")
    return df


def chunk_count(rows: int, features: int, window_size: int | None = None) -> int:
    """How many chunks hold the rows at about CELLS cells each, or at ``window_size`` rows."""
    return max(1, rows // window_size if window_size else int(rows * (features + 2) / CELLS))


class KNN:
    """``KNN(train, y).fit().predict(test)``. A double or float label is regressed, an int or bigint one classified."""

    def __init__(self, df: DataFrame, y: str = "y"):
        if y not in df.columns:
            raise AttributeError(f"there is no column {y}")
        kind = df.schema[y].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            self.task = "regression"
        elif isinstance(kind, (T.IntegerType, T.LongType)):
            self.task = "classification"
        else:
            raise AssertionError(f"{y} must be a number, not {kind.simpleString()}")
        self.df, self.y, self.train = df, y, None

    def fit(self, window_size: int | None = None, idcol: str = "index_train", features: list[str] | None = None) -> KNN:
        """Take the features (by default all columns but id and label). ``window_size`` is accepted; blocks are of bounded size anyway."""
        self.id = idcol
        self.train = with_id(self.df, idcol)
        self.features = features or [c for c in self.train.columns if c not in (idcol, self.y)]
        return self

    def neighbours(self, pred_df: DataFrame, idcol: str = "index_test", n_neighbors: int = 10, metric: str = "euclidean", leave_out_self: bool = False) -> DataFrame:
        """(idcol, train id, distance, rank): the rows that rank up to n_neighbors, ties kept. Features are taken by name, in train order.
        ``leave_out_self``: a row with the query's own id is no neighbour."""
        check_metric(metric)
        if self.train is None:
            raise RuntimeError("fit comes first")
        whole = lambda df: df.where(~F.exists("f", lambda x: x.isNull() | F.isnan(x)))
        test = with_id(pred_df, idcol)
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((test, idcol), (self.train, self.id))]
        near = nearest_in_blocks(whole(pack(test, idcol, self.features)), whole(pack(self.train, self.id, self.features)), n_neighbors + leave_out_self, metric, *kinds)
        if leave_out_self:
            near = near.where("id <> other")
        w = Window.partitionBy("id").orderBy(F.round("distance", 9))
        return near.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= n_neighbors).select(F.col("id").alias(idcol), F.col("other").alias(self.id), "distance", "rank")

    def predict(self, pred_df: DataFrame, pred_df_window_size: int | None = None, idcol: str = "index_test", n_neighbors: int = 10, metric: str = "euclidean", weighted: bool = True, leave_out_self: bool = False) -> DataFrame:
        """Classification: idcol, y, metric (the winner's weight, or votes; ties to the least label). Regression: idcol, y.

        A neighbour weighs one over its squared distance, 1 if that is 0. Rows with null or NaN features get no prediction.
        """
        near = self.neighbours(pred_df, idcol, n_neighbors, metric, leave_out_self)
        weight = F.when(F.col("distance") == 0, 1.0).otherwise(F.try_divide(F.lit(1.0), F.col("distance") * F.col("distance"))) if weighted else F.lit(1.0)
        labelled = near.join(self.train.select(self.id, F.col(self.y).alias("y")), self.id).withColumn("w", weight)
        if self.task == "regression":
            return labelled.groupBy(idcol).agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"))
        votes = labelled.groupBy(idcol, "y").agg((F.sum("w") if weighted else F.count("*")).alias("metric"))
        best = Window.partitionBy(idcol).orderBy(F.round("metric", 9).desc(), "y")
        return votes.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r").select(idcol, "y", "metric")
