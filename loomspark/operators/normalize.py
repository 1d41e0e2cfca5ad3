"""Column normalisation with state that can be saved; one aggregate to fit, one projection to apply."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("minmax", "zscore", "range")
#: The deviation that stands for 0.
TINY = 1e-19


def _methods(method: str | None, columns: list[str] | None, methods: dict[str, str] | None) -> dict[str, str]:
    out = dict(methods) if methods else {c: method or "minmax" for c in columns or []}
    for m in [*out.values(), *([method] if method else [])]:
        if m not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {m!r}")
    return out


class _State:
    """``methods`` (column -> method) wins over ``method`` and ``columns``. Without either the normaliser is for :meth:`load`."""

    def __init__(self, method: str | None = None, columns: list[str] | None = None, methods: dict[str, str] | None = None):
        self.methods = _methods(method, columns, methods)
        self.stats: dict[str, dict[str, float | None]] | None = None

    def _check(self, columns) -> None:
        if missing := [c for c in self.methods if c not in columns]:
            raise ValueError(f"there are no columns {missing}")

    def _ready(self) -> dict:
        if self.stats is None:
            raise RuntimeError("fit or load comes first")
        return self.stats

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"methods": self.methods, "stats": self._ready()}, f)

    def load(self, path: str):
        with open(path) as f:
            got = json.load(f)
        self.methods, self.stats = got["methods"], got["stats"]
        return self


class Normalizer(_State):
    """minmax: (x - min) / (max - min); zscore: (x - mean) / sample deviation; range: (x - mean) / (max - min).

    A constant column gives 0.0; an all-null column, a null value, and the deviation of a single row give null.
    """

    def fit(self, df: DataFrame) -> Normalizer:
        self._check(df.columns)
        wanted = {"minmax": ("min", "max"), "zscore": ("mean", "std"), "range": ("mean", "min", "max")}
        make = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev}
        aggs = [make[s](F.col(c).cast("double")).alias(f"{k}:{s}") for k, (c, m) in enumerate(self.methods.items()) for s in wanted[m]]
        row = df.agg(*aggs).first() if aggs else {}
        self.stats = {c: {s: row[f"{k}:{s}"] for s in wanted[m]} for k, (c, m) in enumerate(self.methods.items())}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame with the columns replaced; also for a stream, as it is a projection."""
        stats = self._ready()
        self._check(df.columns)
        return df.withColumns({c: self._expression(c, m, stats[c]) for c, m in self.methods.items()})

    @staticmethod
    def _expression(c: str, method: str, s: dict):
        if any(v is None for v in s.values()):
            return F.lit(None).cast("double")
        x = F.col(c).cast("double")
        if method == "zscore":
            return (x - s["mean"]) / (s["std"] or TINY)
        width = s["max"] - s["min"]
        if width == 0:
            return F.when(x.isNotNull(), 0.0)
        return (x - (s["min"] if method == "minmax" else s["mean"])) / width

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class NormalizerPandas(_State):
    """The same on pandas frames; the saved state is interchangeable with :class:`Normalizer`'s."""

    def fit(self, df: pd.DataFrame) -> NormalizerPandas:
        self._check(df.columns)
        number = lambda v: None if pd.isna(v) else float(v)
        self.stats = {}
        for c, m in self.methods.items():
            x = df[c].astype(float)
            self.stats[c] = {"mean": number(x.mean()), "std": number(x.std(ddof=1))} if m == "zscore" else {"min": number(x.min()), "max": number(x.max())} | ({"mean": number(x.mean())} if m == "range" else {})
        return self

    def transform(self, df: pd.DataFrame) -> pd.DataFrame:
        out = df.copy()
        for c, m in self.methods.items():
            s, x = self._ready()[c], df[c].astype(float)
            if any(v is None for v in s.values()):
                out[c] = float("nan")
            elif m == "zscore":
                out[c] = (x - s["mean"]) / (s["std"] or TINY)
            elif s["max"] == s["min"]:
                out[c] = x.where(x.isna(), 0.0)
            else:
                out[c] = (x - (s["min"] if m == "minmax" else s["mean"])) / (s["max"] - s["min"])
        return out

    def fit_transform(self, df: pd.DataFrame) -> pd.DataFrame:
        return self.fit(df).transform(df)
