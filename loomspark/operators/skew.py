"""Per-key work without imbalance when a few keys hold most rows: fragment-replicate by estimated load.

The load of each key is counted first (with map-side combining, so the count itself isn't skewed). A key above a task's fair share is
split into shards in proportion to its load; shards and the keys next in size are packed onto tasks, largest first, each on the task
with the least load. What is left is spread by hash: each such key is small against a task. Every row then goes to the task that its
shard was given; rows of a matching side are replicated to the shards of their key and to nothing else.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import shuffle_partitions

#: A key is placed by hand if it holds at least this part of a task's fair share, so at most tasks * 1 / LIGHT keys are.
LIGHT = 1 / 8


@dataclass
class Layout:
    """Where rows go. placed: key -> the tasks of its shards, for the keys placed by hand (their number is bounded by the tasks')."""

    tasks: int
    placed: dict

    def frame(self, like: DataFrame, key: str) -> DataFrame:
        """(key, at): the placed keys as a table to broadcast; a few rows for each task, whatever the data's size."""
        kind = like.schema[key].dataType.simpleString()
        return like.sparkSession.createDataFrame([(k, at) for k, at in self.placed.items()], f"`{key}` {kind}, at array<int>")


def plan_layout(loads: DataFrame, key: str, n: str, tasks: int) -> Layout:
    """Pack the keys of ``loads`` (one row per key, its load in ``n``) onto tasks. Null keys are left out."""
    total = loads.agg(F.sum(n)).first()[0] or 0
    fair = max(1.0, total / tasks)
    rows = loads.where(F.col(key).isNotNull() & (F.col(n) >= fair * LIGHT)).select(key, n).collect()  # at most tasks / LIGHT rows
    light = (total - sum(r[1] for r in rows)) / tasks
    shards = []
    for k, load in rows:
        parts = max(1, -(-int(load) // max(1, int(fair))))
        shards += [(load / parts, str(k), part, k) for part in range(parts)]
    bins = [(light, t) for t in range(tasks)]
    heapq.heapify(bins)
    placed: dict = {}
    for load, _, _, k in sorted(shards, key=lambda x: (-x[0], x[1], x[2])):
        have, t = heapq.heappop(bins)
        placed.setdefault(k, []).append(t)
        heapq.heappush(bins, (have + load, t))
    return Layout(tasks, placed)


def _light_task(key: str, tasks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int")


def fragment(df: DataFrame, key: str, salt: list[str], layout: Layout, task: str = "__task") -> DataFrame:
    """Send each row to one task, adding its number. Rows alike in ``salt`` go together, so counts distinct in it add up over shards."""
    at = F.broadcast(layout.frame(df, key).withColumnRenamed(key, "__key"))
    shard = F.pmod(F.xxhash64(*salt), F.size("at")).cast("int")
    sent = df.join(at, F.col(key) == F.col("__key"), "left").withColumn(task, F.coalesce(F.get("at", shard), _light_task(key, layout.tasks))).drop("__key", "at")
    return sent.repartitionById(layout.tasks, F.col(task))


def replicate(df: DataFrame, key: str, layout: Layout, task: str = "__task") -> DataFrame:
    """Send each row of a matching side to every task that holds a shard of its key."""
    at = F.broadcast(layout.frame(df, key).withColumnRenamed(key, "__key"))
    many = F.coalesce(F.array_distinct("at"), F.array(_light_task(key, layout.tasks)))
    return df.join(at, F.col(key) == F.col("__key"), "left").withColumn(task, F.explode(many)).drop("__key", "at")


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, salt: list[str], *, tasks: int | None = None) -> DataFrame:
    """Inner join on ``key``, the skewed ``left`` split by load and ``right`` replicated to the shards only. Null keys match nothing.

    Columns of ``right`` that ``left`` has too, but for the key, come out with the suffix ``_right``.
    """
    clash = [c for c in right.columns if c in left.columns and c != key]
    right = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    tasks = tasks or shuffle_partitions(left.sparkSession)
    layout = plan_layout(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")), key, "__n", tasks)
    return fragment(left, key, salt, layout).join(replicate(right, key, layout), ["__task", key]).drop("__task")


def bucket_totals(points: DataFrame, *, key: str = "bucket_key", point: str = "point_id", weight: str = "weight", tasks: int | None = None) -> DataFrame:
    """One row for each key: bucket_key, bucket_size (distinct points), total_weight, weighted (points with a usable weight).

    Keys are read without blanks. Rows with a null key or null point are left out. A point counts once for each key, with its largest
    usable weight (null, NaN and weights up to 0 aren't usable); total_weight is null where no point has one. No rows come out of an
    empty table; other columns are ignored.
    """
    w = F.col(f"`{weight}`").cast("double")
    rows = points.select(
        F.regexp_replace(F.col(f"`{key}`"), r"[\s\x{00a0}]+", "").alias("bucket_key"),
        F.col(f"`{point}`").alias("point_id"),
        F.when((w > 0) & ~F.isnan(w), w).alias("w"),
    ).where("bucket_key IS NOT NULL AND point_id IS NOT NULL")
    tasks = tasks or shuffle_partitions(points.sparkSession)
    layout = plan_layout(rows.groupBy("bucket_key").agg(F.count("*").alias("n")), "bucket_key", "n", tasks)
    once = fragment(rows, "bucket_key", ["point_id"], layout).groupBy("__task", "bucket_key", "point_id").agg(F.max("w").alias("w"))
    shard = once.groupBy("__task", "bucket_key").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.count("w").alias("k"))
    return shard.groupBy("bucket_key").agg(F.sum("n").alias("bucket_size"), F.sum("w").alias("total_weight"), F.sum("k").alias("weighted"))


def heavy_keys(points: DataFrame, share: float, *, key: str = "bucket_key", point: str = "point_id", tasks: int | None = None) -> DataFrame:
    """The rows of :func:`bucket_totals` whose key holds at least ``share`` of the distinct points that have a key."""
    totals = bucket_totals(points, key=key, point=point, tasks=tasks)
    every = points.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{point}`").isNotNull()).select(F.col(f"`{point}`").alias("p")).distinct().agg(F.count("*").alias("__all"))
    return totals.join(F.broadcast(every), F.col("bucket_size") >= F.col("__all") * F.lit(share)).drop("__all")
