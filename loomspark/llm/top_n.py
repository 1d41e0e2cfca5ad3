"""The N best items of every group, by statistics-guided skipping.

A table is clustered by (group, score): its files hold the groups in order, and inside a group the best rows first; each file is one row
group. Clustering is one shuffle and can be done once for many questions (:func:`cluster_by_group`). Reading then goes by the files'
statistics. The first wave takes every file in which groups begin and the best file of each group that fills whole files; after it the
N-th score of those groups is known, and of the remaining files, taken in descending maximum score, only those that aren't strictly
below it are read, until none is left. Waves are ordinary scans of the files chosen.

A group's size is no matter: the clustering splits it over as many files as it fills, and all but its first files are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.session import Workspace, delete_path, estimated_bytes, shuffle_partitions

#: Rows of a file at least: what a skip saves, and what the head of a large group costs. Large tables get larger files, about FILES for each partition.
FILE_ROWS, FILES = 8_192, 32


def cluster_by_group(
    df: DataFrame, path: str, group: str, item: str, score: str, *, largest: bool = True, at_least: float | None = None, partitions: int | None = None, file_rows: int | None = None
) -> None:
    """Write the usable rows of ``df`` to ``path``, clustered for :func:`top_n_of_clustered`.

    A row is usable if group, item and score are not null and the score is finite (and not below ``at_least``). Other columns are left
    out, so names can't clash.
    """
    s = F.col(f"`{score}`").cast("double")
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), (s if largest else -s).alias("s"), s.alias("raw"))
    fine = F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("raw").isNotNull() & ~F.isnan("raw") & (F.abs("raw") < float("inf"))
    if at_least is not None:
        fine &= F.col("raw") >= at_least
    n = partitions or shuffle_partitions(df.sparkSession)
    rows = rows.where(fine).drop("raw")
    most = file_rows or max(FILE_ROWS, estimated_bytes(rows) // 24 // (FILES * n))
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", most).mode("overwrite").parquet(path)


def _open(path: str):
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, inner = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(inner))


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each file, from its footer: whether it holds one group only, that group, and its best score."""
    for batch in batches:
        out = []
        for path in batch["path"]:
            meta = _open(path).metadata
            at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
            parts = [(meta.row_group(k).column(at["g"]).statistics, meta.row_group(k).column(at["s"]).statistics) for k in range(meta.num_row_groups)]
            known = bool(parts) and all(x is not None and x.has_min_max for p in parts for x in p)
            one = known and min(g.min for g, _ in parts) == max(g.max for g, _ in parts)
            out.append((path, bool(one), str(parts[0][0].min) if one else None, float(max(s.max for _, s in parts)) if known else np.inf, meta.num_rows))
        yield pd.DataFrame(out, columns=["path", "one", "only", "best", "n"])


def top_n_of_clustered(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, dict]:
    """The n best rows (g, i, s, rank) of every group of a table written by :func:`cluster_by_group`, and how many files and rows were read.

    A pair that occurs several times counts once, with its best score. Ties of the score go to the smaller item, so the order is the same
    on each run. An empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    table = spark.read.parquet(path)
    schema, ws = table.schema, Workspace(spark)
    per = shuffle_partitions(spark)
    files = spark.createDataFrame([(f,) for f in table.inputFiles()], "path string")
    catalog = files.repartition(per, "path").mapInPandas(_stats, "path string, one boolean, only string, best double, n long")
    # a group's files in descending best score; those in which groups begin are always read
    ranked = catalog.withColumn("turn", F.when(~F.col("one"), 0).otherwise(F.row_number().over(Window.partitionBy("only", "one").orderBy(F.col("best").desc(), "path")) - 1))
    turns = ws.keep(ranked, "turns")
    by_score = Window.partitionBy("g").orderBy(F.col("s").desc(), "i")
    done = {"files": 0, "read": 0, "rows": 0, "rows_read": 0, "waves": 0}
    done["files"], done["rows"] = turns.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def wave(chosen: DataFrame) -> DataFrame | None:
        """The rows of the files chosen: a list of paths, which a scan has on the driver anyway."""
        paths = chosen.select("path", "n").collect()
        done["read"], done["rows_read"], done["waves"] = done["read"] + len(paths), done["rows_read"] + sum(p.n for p in paths), done["waves"] + bool(paths)
        return spark.read.schema(schema).parquet(*(p.path for p in paths)) if paths else None

    def cut(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("g", "i").agg(F.max("s").alias("s"))
        return once.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n)

    first = wave(turns.where("turn = 0"))
    top = ws.keep(cut(first if first is not None else table), "top")
    lo, width = 1, 1
    while True:
        nth = top.groupBy(F.col("g").cast("string").alias("only")).agg(F.count("*").alias("have"), F.min("s").alias("nth"))
        left = turns.where(F.col("one") & (F.col("turn") >= lo)).join(nth, "only", "left").where(F.col("nth").isNull() | (F.col("have") < n) | (F.col("best") >= F.col("nth")))
        left = ws.keep(left, "left")
        if left.isEmpty():
            break
        if (more := wave(left.where(F.col("turn") < lo + width))) is not None:
            newer = ws.keep(cut(top.drop("rank").unionByName(more)), "top")
            ws.drop(top)
            top = newer
        ws.drop(left)
        lo, width = lo + width, width * 4
    return top, done


def top_n_by_group(df: DataFrame, n: int, group: str = "index_test", item: str = "index_train", score: str = "distance", *, largest: bool = False, at_least: float | None = None, log: dict | None = None) -> DataFrame:
    """The n best items of every group: columns group, item, score (double) and rank (1 is best; ties to the smaller item).

    Rows with a null group or item, or with a null, NaN or infinite score (or one below ``at_least``), don't count; a pair given several
    times counts once with its best score; a group of fewer than n items keeps all of them; an empty table gives no rows. ``log`` receives
    the numbers of files and rows, and of those read.
    """
    spark = df.sparkSession
    ws = Workspace(spark)
    path = ws.path("clustered")
    cluster_by_group(df, path, group, item, score, largest=largest, at_least=at_least)
    top, read = top_n_of_clustered(spark, path, n)
    if log is not None:
        log.update(read)
    delete_path(spark, path)
    return top.select(F.col("g").alias(group), F.col("i").alias(item), (F.col("s") if largest else -F.col("s") + F.lit(0.0)).alias(score), F.col("rank").cast("int").alias("rank"))
