"""Epochs of shuffled batches for model training, with the pairs inside each batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.session import Workspace


#: Chunks of one folder.
FOLDER = 64


class BatchGenerator:
    """Batches of a catalog table (or frame), and optionally of its pair table."""

    def __init__(self, spark: SparkSession, df: str | DataFrame, df_adj: str | DataFrame | None = None):
        table = lambda t: spark.table(t) if isinstance(t, str) else t
        self.spark, self.df = spark, table(df)
        self.adj = None if df_adj is None else table(df_adj)

    def split(self, chunk_size: int = 256, idcol: str = "id", seed: int | None = None) -> DataFrame:
        """The rows with ``chunk`` (1, 2, …): a random order cut into chunks of chunk_size, the last one smaller, none empty.

        Rows are numbered by a distributed sort: each sorted partition's rows are counted, and numbers start where those before it end.
        """
        if chunk_size < 1:
            raise ValueError("chunk_size must be 1 or more")
        ws = Workspace(self.spark)
        order = self.df.withColumn("__r", F.rand(seed) if seed is not None else F.rand())
        placed = ws.keep(order.repartitionByRange("__r", idcol).sortWithinPartitions("__r", idcol).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()), "order")
        parts = placed.groupBy("__p").agg(F.count("*").alias("n"), F.min("__k").alias("k0")).orderBy("__p").collect()  # one row per partition
        start, rows = 0, []
        for r in parts:
            rows.append((r["__p"], start - r["k0"]))
            start += r["n"]
        shift = self.spark.createDataFrame(rows, "__p int, __s long")
        at = placed.join(F.broadcast(shift), "__p").withColumn("chunk", (F.floor((F.col("__k") + F.col("__s")) / chunk_size) + 1).cast("int"))
        # folders of FOLDER chunks, so reading one batch opens one folder's files
        path = ws.path("chunks")
        at = at.drop("__r", "__p", "__k", "__s")
        at.withColumn("__folder", F.floor((F.col("chunk") - 1) / FOLDER)).write.partitionBy("__folder").parquet(path)
        ws.drop(placed)
        read = self.spark.read.schema(at.withColumn("__folder", F.lit(0).cast("long")).schema).parquet(path)
        self.folders = read
        return read.drop("__folder")

    def get_df_generator(self, chunk_size: int = 256, idcol: str = "id", num_epoch: int = 4, quadratic: bool = False, seed: int | None = None) -> Iterator[tuple]:
        """(epoch, batch[, pairs]) from epoch 1 on; pairs have their first end in the batch, and with ``quadratic`` the second one too."""
        for epoch in range(1, num_epoch + 1):
            rows = self.split(chunk_size, idcol, None if seed is None else seed + epoch)
            last = rows.agg(F.max("chunk")).first()[0] or 0
            for chunk in range(1, last + 1):
                batch = self.folders.where((F.col("__folder") == (chunk - 1) // FOLDER) & (F.col("chunk") == chunk)).drop("chunk", "__folder")
                if self.adj is None:
                    yield epoch, batch
                    continue
                ids = batch.select(idcol)
                first = idcol if idcol in self.adj.columns else f"{idcol}_A"
                pairs = self.adj.join(ids.withColumnRenamed(idcol, first), first, "left_semi")
                if quadratic:
                    pairs = pairs.join(ids.withColumnRenamed(idcol, f"{idcol}_B"), f"{idcol}_B", "left_semi").select(*self.adj.columns)
                yield epoch, batch, pairs


class BatchedStreamProcessor:
    """Turns a generator's frames to pandas some batches ahead, in the generator's order; errors are raised."""

    def __init__(self, buffer_size: int = 5):
        self.buffer_size = max(1, buffer_size)

    def batched_stream(self, generator: Iterator[tuple]) -> Iterator[tuple]:
        fetch = lambda item: tuple(x.toPandas() if isinstance(x, DataFrame) else x for x in item)
        waiting: deque = deque()
        with ThreadPoolExecutor(self.buffer_size) as pool:
            for item in generator:
                waiting.append(pool.submit(fetch, item))
                if len(waiting) > self.buffer_size:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()


def to_pandas_batches(generator: Iterator[tuple]) -> Iterator[tuple[int, pd.DataFrame]]:
    return BatchedStreamProcessor().batched_stream(generator)
