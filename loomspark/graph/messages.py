"""Column handles for messages along edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import shared_dir


class _Handles:
    @property
    def src(self) -> Column:
        """The source vertex, a struct of its columns."""
        return F.col("src")

    @property
    def dst(self) -> Column:
        """The destination vertex."""
        return F.col("dst")

    @property
    def edge(self) -> Column:
        """The edge."""
        return F.col("edge")

    @property
    def msg(self) -> Column:
        """The message, in an aggregate; in SQL its name is MSG."""
        return F.col("MSG")

    @staticmethod
    def getCachedDataFrame(df: DataFrame) -> DataFrame:
        """The frame with its lineage cut, for loops: written to the folder all executors share."""
        shared_dir(df.sparkSession)
        return df.checkpoint(eager=True)


AggregateMessages = _Handles()


def send(triplets: DataFrame, to_src: list[Column], to_dst: list[Column], name: str) -> DataFrame:
    """(id, message) rows of all messages that aren't null."""
    out = None
    for end, messages in (("src", to_src), ("dst", to_dst)):
        for m in messages:
            one = triplets.select(F.col(f"{end}.id").alias("id"), m.alias(name)).where(F.col(name).isNotNull())
            out = one if out is None else out.unionByName(one)
    return out
