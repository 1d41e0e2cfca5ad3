"""Catalog tables, parquet and JDBC databases.

JDBC drivers aren't part of this repository: put their jars on the session's class path. The option builders are tested, the
connections are not.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CLICKHOUSE_DRIVER = "com.clickhouse.jdbc.ClickHouseDriver"
POSTGRES_DRIVER = "org.postgresql.Driver"


def _name(table: str, database: str | None) -> str:
    return f"{database}.{table}" if database else table


def read_table(spark: SparkSession, table: str, database: str | None = None) -> DataFrame:
    """A catalog table as it is now."""
    name = _name(table, database)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def save_table(df: DataFrame, table: str, database: str | None = None, save_mode: str = "overwrite", partition_by: str | list[str] | None = None) -> None:
    """overwrite: a parquet table, partitioned if wanted; append: rows into an existing table, columns matched by name."""
    if save_mode not in ("overwrite", "append"):
        raise AssertionError(f"save_mode must be overwrite or append, not {save_mode!r}")
    by = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if missing := [c for c in by if c not in df.columns]:
        raise AttributeError(f"there are no columns {missing}")
    name = _name(table, database)
    if save_mode == "append":
        df.select(*df.sparkSession.table(name).columns).write.insertInto(name)
        return
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def publish(df: DataFrame, name: str) -> None:
    """A view that all sessions of the application read as global_temp.<name>."""
    df.createOrReplaceGlobalTempView(name)


def in_memory(spark: SparkSession, rows: list | pd.DataFrame, schema: str | None = None) -> DataFrame:
    return spark.createDataFrame(rows, schema) if schema else spark.createDataFrame(rows)


def jdbc_options(url: str, table: str, user: str, password: str, driver: str, **more: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver} | more


def parallel_read(column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Options that split a JDBC read into ranges of a numeric column; without them a single task reads the table."""
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}


def merge_tree_options(order_by: str | list[str]) -> dict[str, str]:
    """The table engine that the column store needs to create a table."""
    columns = [order_by] if isinstance(order_by, str) else order_by
    return {"createTableOptions": f"engine=MergeTree() order by ({', '.join(columns)})"}


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def save_jdbc(df: DataFrame, options: dict[str, str], save_mode: str = "append") -> None:
    df.write.format("jdbc").options(**options).mode(save_mode).save()


def clickhouse_read_table(spark: SparkSession, url: str, table: str, user: str, password: str, driver: str = CLICKHOUSE_DRIVER, **more: str) -> DataFrame:
    return read_jdbc(spark, jdbc_options(url, table, user, password, driver, **more))


def clickhouse_save_table(df: DataFrame, table: str, url: str, order_by: str | list[str], user: str, password: str, driver: str = CLICKHOUSE_DRIVER, save_mode: str = "append") -> None:
    save_jdbc(df, jdbc_options(url, table, user, password, driver, **merge_tree_options(order_by)), save_mode)


def postgres_read_table(spark: SparkSession, url: str, table: str, user: str, password: str, driver: str = POSTGRES_DRIVER, **more: str) -> DataFrame:
    return read_jdbc(spark, jdbc_options(url, table, user, password, driver, **more))


def postgres_save_table(df: DataFrame, url: str, table: str, user: str, password: str, driver: str = POSTGRES_DRIVER, save_mode: str = "append") -> None:
    save_jdbc(df, jdbc_options(url, table, user, password, driver), save_mode)
