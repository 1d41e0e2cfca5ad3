"""Sessions, size-aware repartitioning and the shared scratch space."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class Profile:
    """Cluster shape from which a Spark configuration is derived."""

    executors: int = 100
    cores: int = 5
    max_cores: int = 500
    memory_gb: int = 25
    name: str = "loomspark"
    warehouse: str | None = None
    dynamic: bool = False
    heavy_gc: bool = False
    yarn: bool = True
    jars: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    @property
    def shuffle_partitions(self) -> int:
        """2.6 tasks for every core, whole executors only when they come and go."""
        slots = self.max_cores // self.cores * self.cores if self.dynamic else self.executors * self.cores
        return int(slots * 2.6)

    def conf(self) -> dict[str, str]:
        out = {
            "spark.app.name": self.name,
            "spark.master": "yarn" if self.yarn else "local[*]",
            "spark.executor.cores": str(self.cores),
            "spark.executor.memory": f"{self.memory_gb}g",
            "spark.executor.memoryOverhead": f"{math.ceil(self.memory_gb * 102.4)}m",
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.sql.sources.partitionOverwriteMode": "dynamic",
            "spark.sql.session.timeZone": "UTC",
            "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        }
        if self.dynamic:
            out |= {
                "spark.dynamicAllocation.enabled": "true",
                "spark.dynamicAllocation.shuffleTracking.enabled": "true",
                "spark.dynamicAllocation.maxExecutors": str(max(1, self.max_cores // self.cores)),
            }
        else:
            out["spark.executor.instances"] = str(self.executors)
        if self.heavy_gc:
            out["spark.executor.extraJavaOptions"] = "-XX:+UseG1GC -XX:InitiatingHeapOccupancyPercent=35"
        if self.warehouse:
            out["spark.sql.warehouse.dir"] = self.warehouse
        if self.jars:
            out["spark.jars"] = ",".join(self.jars)
        return out | self.extra


def connect(profile: Profile | None = None) -> SparkSession:
    """The session of a profile; an existing one is reused."""
    return SparkSession.builder.config(map=(profile or Profile(yarn=False)).conf()).getOrCreate()


class connected:
    """``with connected(profile) as spark``: the session ends and its checkpoints go when the block ends."""

    def __init__(self, profile: Profile | None = None):
        self.profile = profile

    def __enter__(self) -> SparkSession:
        self.spark = connect(self.profile)
        return self.spark

    def __exit__(self, *exc) -> None:
        clear_scratch(self.spark)
        delete_checkpoints(self.spark)
        self.spark.stop()


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that owns it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_checkpoints(spark: SparkSession) -> None:
    if path := spark.sparkContext.getCheckpointDir():
        delete_path(spark, path)


#: Folders of the workspaces of this process.
_ROOTS: set[str] = set()


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that operators have written to the shared folder; frames that still read them become unusable."""
    while _ROOTS:
        delete_path(spark, _ROOTS.pop())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, and only where that is unset a folder of this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(shutil.rmtree, path, True)
        base = f"file://{path}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


class Workspace:
    """Tables written to the shared folder: they cut the lineage and outlive lost executors.

    ``keep`` writes a frame and returns it as read back; ``drop`` removes what is no longer needed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/loom-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        _ROOTS.add(self.root)
        return f"{self.root}/{name}-{self.made}"

    def keep(self, df: DataFrame, name: str = "t", **options) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if path := getattr(df, "_loom_path", None):
                delete_path(self.spark, path)


    def sweep(self) -> None:
        """Let go of the shuffle files of plans that are over: Spark deletes them once the driver has collected the plans. For loops of large shuffles."""
        gc.collect()
        self.spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the optimized plan's size; the one place that needs the JVM plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partition_count(size: int, mode: str = "parquet", block_bytes: int = BLOCK_BYTES, compression: float = 8) -> int:
    """Blocks that a frame of this size fills, at least one (an empty frame too)."""
    if mode not in ("parquet", "memory"):
        raise AssertionError(f"mode must be parquet or memory, not {mode!r}")
    if compression < 1:
        raise ValueError("compression must be 1 or more")
    return max(1, math.ceil(size / (block_bytes * (compression if mode == "parquet" else 1))))


def repartition_by_size(df: DataFrame, mode: str = "parquet", columns: list[str] | None = None, block_bytes: int = BLOCK_BYTES, compression: float = 8) -> DataFrame:
    """As many partitions as the estimated size fills; one partition is reached without a shuffle."""
    n = partition_count(estimated_bytes(df), mode, block_bytes, compression)
    if n == 1:
        return df.coalesce(1)
    return df.repartition(n, *map(F.col, columns)) if columns else df.repartition(n)


def repartition_and_checkpoint(df: DataFrame, columns: list[str] | None = None, **kw) -> DataFrame:
    """Repartition by size and cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return repartition_by_size(df, "memory", columns, **kw).checkpoint(eager=True)
