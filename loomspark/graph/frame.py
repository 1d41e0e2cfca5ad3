"""A graph: vertices with an ``id`` and edges with ``src`` and ``dst``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.graph import algorithms
from loomspark.graph.messages import send
from loomspark.graph.pregel import Pregel, _triplets
from loomspark.session import shared_dir

_VERTEX = r"\(\s*(\w*)\s*\)"
_TERM = re.compile(rf"(!?)\s*{_VERTEX}\s*(?:-\s*\[\s*(\w*)\s*\]\s*->\s*{_VERTEX})?$")


def _condition(c: Column | str) -> Column:
    if isinstance(c, str):
        return F.expr(c)
    if isinstance(c, Column):
        return c
    raise TypeError(f"a condition is a Column or an SQL string, not {type(c).__name__}")


class GraphFrame:
    """Missing columns raise ``ValueError``. Vertices and edges may have further columns, also of the same names."""

    def __init__(self, v: DataFrame, e: DataFrame):
        if "id" not in v.columns:
            raise ValueError(f"vertices need the column id, they have {v.columns}")
        for c in ("src", "dst"):
            if c not in e.columns:
                raise ValueError(f"edges need the column {c}, they have {e.columns}")
        self._vertices, self._edges = v, e

    @property
    def vertices(self) -> DataFrame:
        return self._vertices

    @property
    def edges(self) -> DataFrame:
        return self._edges

    def __repr__(self) -> str:
        return f"GraphFrame(v:{self.vertices}, e:{self.edges})"

    def persist(self, *level) -> GraphFrame:
        self.vertices.persist(*level)
        self.edges.persist(*level)
        return self

    def cache(self) -> GraphFrame:
        return self.persist()

    def unpersist(self, blocking: bool = False) -> GraphFrame:
        self.vertices.unpersist(blocking)
        self.edges.unpersist(blocking)
        return self

    # degrees; vertices without edges are in no row

    @property
    def outDegrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("int").alias("outDegree"))

    @property
    def inDegrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("int").alias("inDegree"))

    @property
    def degrees(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").cast("int").alias("degree"))

    @property
    def triplets(self) -> DataFrame:
        return _triplets(self.vertices, self.edges).select("src", "edge", "dst")

    # subgraphs

    def filterVertices(self, condition: Column | str) -> GraphFrame:
        v = self.vertices.where(_condition(condition))
        ids = v.select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return GraphFrame(v, e.select(*self.edges.columns))

    def filterEdges(self, condition: Column | str) -> GraphFrame:
        return GraphFrame(self.vertices, self.edges.where(_condition(condition)))

    def dropIsolatedVertices(self) -> GraphFrame:
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return GraphFrame(self.vertices.join(ends, "id", "left_semi"), self.edges)

    # patterns and paths

    def find(self, pattern: str) -> DataFrame:
        """Matches of a pattern such as ``(a)-[e]->(b); (b)-[]->(c); !(c)-[]->(a)``: one struct column for each named element.

        Terms are joined on the vertices they share; a negated term removes the matches for which such an edge exists.
        """
        terms = []
        for text in filter(None, (t.strip() for t in pattern.split(";"))):
            if not (m := _TERM.match(text)):
                raise ValueError(f"this term can't be read: {text!r}")
            terms.append((m[1] == "!", m[2], m[3], m[4]))
        out, named, anonymous = None, [], 0
        for negated, a, e, b in sorted(terms, key=lambda t: t[0]):  # negated terms last
            if negated and (e or not (a in named or b in named)):
                raise ValueError("a negated term names no edge and shares a vertex with another")
            keys = []
            for x in (a, b):
                if x is not None and not x:
                    anonymous += 1
                keys.append(x or f"__{anonymous}")
            ka, kb = keys
            if e is None:
                part = self.vertices.select(F.struct("*").alias(ka), F.col("id").alias(f"@{ka}"))
                ids = [ka]
            else:
                edge = self.edges.select(F.col("src").alias(f"@{ka}"), F.col("dst").alias(f"@{kb}") if kb != ka else F.col("dst").alias("@@"), F.struct("*").alias(e or "__e"))
                part = edge if kb != ka else edge.where(F.col(f"@{ka}") == F.col("@@")).drop("@@")
                if not e:
                    part = part.drop("__e")
                ids = list(dict.fromkeys(keys))
            shared = [f"@{x}" for x in ids if out is not None and f"@{x}" in out.columns]
            if negated:
                out = out.join(part.select(*shared).distinct(), shared, "left_anti")
                continue
            for x in ids:  # structs of vertices not seen before
                if e is not None and x not in named and (out is None or f"@{x}" not in out.columns):
                    part = part.join(self.vertices.select(F.col("id").alias(f"@{x}"), F.struct("*").alias(x)), f"@{x}")
            out = part if out is None else out.join(part, shared) if shared else out.crossJoin(part)
            named += [x for x in (a, e, b) if x and x not in named]
        return out.select(*named)

    def bfs(self, fromExpr: str, toExpr: str, edgeFilter: str | None = None, maxPathLength: int = 10) -> DataFrame:
        """All shortest paths: columns from, e0, v1, e1, …, to; no rows if there is none within the limit."""
        v = self.vertices
        e = self.edges.where(edgeFilter) if edgeFilter else self.edges
        shared_dir(v.sparkSession)
        start, goal = v.where(fromExpr), v.where(toExpr)
        both = start.where(toExpr)
        if not both.isEmpty():
            return both.select(F.struct("*").alias("from"), F.struct("*").alias("to"))
        structs = v.select(F.col("id").alias("__n"), F.struct("*").alias("__v"))
        ends = goal.select(F.col("id").alias("__n"))
        paths = start.select(F.struct("*").alias("from"), F.col("id").alias("__at"))
        seen = start.select(F.col("id").alias("__n")).distinct()
        for step in range(maxPathLength):
            hop = e.select(F.col("src").alias("__at"), F.col("dst").alias("__n"), F.struct("*").alias(f"e{step}"))
            # a vertex reached by a shorter path ends no shortest one
            paths = paths.join(hop, "__at").drop("__at").join(seen, "__n", "left_anti")
            paths = paths.checkpoint(eager=True)
            if paths.isEmpty():
                break
            found = paths.join(ends, "__n", "left_semi")
            if not found.isEmpty():
                named = found.join(structs, "__n").withColumnRenamed("__v", "to")
                order = ["from", *(x for k in range(step) for x in (f"e{k}", f"v{k + 1}")), f"e{step}", "to"]
                return named.select(*order)
            seen = seen.union(paths.select("__n")).distinct().checkpoint(eager=True)
            paths = paths.join(structs, "__n").withColumnsRenamed({"__n": "__at", "__v": f"v{step + 1}"})
        return v.limit(0).select(F.struct("*").alias("from"), F.struct("*").alias("to"))

    # messages

    def aggregateMessages(self, aggCol: Column | str, sendToSrc: Column | str | None = None, sendToDst: Column | str | None = None) -> DataFrame:
        """One row (id, aggregate) for each vertex that gets a message that isn't null; in SQL the message is MSG."""
        if sendToSrc is None and sendToDst is None:
            raise ValueError("a message to the source or to the destination is needed")
        to_src = [] if sendToSrc is None else [_condition(sendToSrc)]
        to_dst = [] if sendToDst is None else [_condition(sendToDst)]
        return send(self.triplets, to_src, to_dst, "MSG").groupBy("id").agg(_condition(aggCol))

    @property
    def pregel(self) -> Pregel:
        return Pregel(self)

    # algorithms

    def connectedComponents(self, algorithm: str = "graphframes", checkpointInterval: int = 2, broadcastThreshold: int = 1_000_000) -> DataFrame:
        """Vertices with ``component``, the least id of their weakly connected component. The parameters are accepted for compatibility."""
        return algorithms.connected_components(self)

    def stronglyConnectedComponents(self, maxIter: int) -> DataFrame:
        return algorithms.strongly_connected_components(self, maxIter)

    def labelPropagation(self, maxIter: int) -> DataFrame:
        return algorithms.label_propagation(self, maxIter)

    def pageRank(self, resetProbability: float = 0.15, sourceId=None, maxIter: int | None = None, tol: float | None = None) -> GraphFrame:
        assert (maxIter is None) != (tol is None), "exactly one of maxIter and tol is needed"
        return algorithms.page_rank(self, resetProbability, sourceId, maxIter, tol)

    def parallelPersonalizedPageRank(self, resetProbability: float = 0.15, sourceIds: list | None = None, maxIter: int | None = None) -> GraphFrame:
        assert sourceIds, "source ids are needed"
        assert maxIter is not None, "maxIter is needed"
        return algorithms.personalized_page_ranks(self, resetProbability, sourceIds, maxIter)

    def shortestPaths(self, landmarks: list) -> DataFrame:
        return algorithms.shortest_paths(self, landmarks)

    def triangleCount(self) -> DataFrame:
        return algorithms.triangle_count(self)

    def svdPlusPlus(self, rank: int = 10, maxIter: int = 2, minValue: float = 0.0, maxValue: float = 5.0, gamma1: float = 0.007, gamma2: float = 0.007, gamma6: float = 0.005, gamma7: float = 0.015) -> tuple[DataFrame, float]:
        return algorithms.svd_plus_plus(self, rank, maxIter, minValue, maxValue, gamma1, gamma2, gamma6, gamma7)


Graph = GraphFrame
