"""Graphs as two DataFrames, and algorithms on them as DataFrame plans."""

from loomspark.graph.frame import Graph, GraphFrame
from loomspark.graph.messages import AggregateMessages
from loomspark.graph.pregel import Pregel

__all__ = ["AggregateMessages", "Graph", "GraphFrame", "Pregel"]
