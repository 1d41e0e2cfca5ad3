"""Bulk-synchronous message passing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.graph.messages import send
from loomspark.session import shared_dir

MESSAGE = "_pregel_msg_"


def _col(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


class Pregel:
    """Builder of a superstep loop over a graph; ``run`` gives the vertices with their last values."""

    def __init__(self, graph):
        self.graph = graph
        self._iterations, self._interval = 10, 2
        self._columns: list[tuple[str, Column, Column]] = []
        self._to_src: list[Column] = []
        self._to_dst: list[Column] = []
        self._agg: Column | None = None

    def setMaxIter(self, value: int) -> Pregel:
        self._iterations = value
        return self

    def setCheckpointInterval(self, value: int) -> Pregel:
        """Lineage is cut every so many supersteps; 0 never."""
        self._interval = value
        return self

    def withVertexColumn(self, name: str, initial: Column | str, update: Column | str) -> Pregel:
        """A column of every vertex: its first value, and its next one, which may use the message (null if none came)."""
        self._columns.append((name, _col(initial), _col(update)))
        return self

    def sendMsgToSrc(self, message: Column | str) -> Pregel:
        self._to_src.append(_col(message))
        return self

    def sendMsgToDst(self, message: Column | str) -> Pregel:
        self._to_dst.append(_col(message))
        return self

    def aggMsgs(self, agg: Column | str) -> Pregel:
        self._agg = _col(agg)
        return self

    def run(self) -> DataFrame:
        if not self._columns or self._agg is None or not (self._to_src or self._to_dst):
            raise ValueError("a vertex column, a message and an aggregate are needed")
        v, e = self.graph.vertices, self.graph.edges
        shared_dir(v.sparkSession)
        now = v.select("*", *(i.alias(n) for n, i, _ in self._columns))
        for step in range(1, self._iterations + 1):
            messages = send(_triplets(now, e), self._to_src, self._to_dst, MESSAGE)
            got = messages.groupBy("id").agg(self._agg.alias(MESSAGE))
            now = now.join(got, "id", "left").select(*v.columns, *(u.alias(n) for n, _, u in self._columns))
            if self._interval and step % self._interval == 0:
                now = now.checkpoint(eager=True)
        return now

    @staticmethod
    def msg() -> Column:
        return F.col(MESSAGE)

    @staticmethod
    def src(name: str) -> Column:
        return F.col(f"src.{name}")

    @staticmethod
    def dst(name: str) -> Column:
        return F.col(f"dst.{name}")

    @staticmethod
    def edge(name: str) -> Column:
        return F.col(f"edge.{name}")


def _triplets(v: DataFrame, e: DataFrame) -> DataFrame:
    src = v.select(F.col("id").alias("__s"), F.struct("*").alias("src"))
    dst = v.select(F.col("id").alias("__d"), F.struct("*").alias("dst"))
    edge = e.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.struct("*").alias("edge"))
    return edge.join(src, "__s").join(dst, "__d").select("src", "edge", "dst")
