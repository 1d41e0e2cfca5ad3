"""Fitted operators applied to streams: all are projections, so a stream and a table get the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomspark.functions.lsh import MultiBucketLSH
from loomspark.operators.normalize import Normalizer


def bucketed(stream: DataFrame, lsh: MultiBucketLSH) -> DataFrame:
    return lsh.transform(stream)


def normalized(stream: DataFrame, fitted: Normalizer) -> DataFrame:
    return fitted.transform(stream)
