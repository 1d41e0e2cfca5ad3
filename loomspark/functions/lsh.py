"""Locality-sensitive buckets of several widths, and sampling by bucket density."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import Workspace

INT = np.iinfo(np.int32)


class MultiBucketLSH:
    """Projections to ``num_hashes`` directions, cut to bins of each width: columns {prefix}_0, {prefix}_1, … of arrays of int.

    ``random_proj`` draws normal directions of unit length, else Cauchy ones. The draws are those of numpy's legacy generator with
    ``seed``; the global generator is left alone.
    """

    #: Whether Cauchy directions are divided by the median of their absolute values.
    scaled = False

    def __init__(self, input_cols: list[str], num_hashes: int = 35, bin_widths: list[float] | None = None, random_proj: bool = False, seed: int | None = None, output_prefix: str = "bins"):
        if num_hashes <= 0:
            raise ValueError("num_hashes must be positive")
        self.input_cols, self.num_hashes, self.dim = list(input_cols), num_hashes, len(input_cols)
        self.bin_widths = list(bin_widths) if bin_widths is not None else [1.0, 5.0]
        self.random_proj, self.seed, self.output_prefix = random_proj, seed, output_prefix
        self.projections = self._draw()

    def _draw(self) -> np.ndarray:
        rng, shape = np.random.RandomState(self.seed), (self.num_hashes, self.dim)
        if self.random_proj:
            p = rng.randn(*shape)
            scale = np.linalg.norm(p, axis=1, keepdims=True)
        else:
            p = rng.standard_cauchy(size=shape)
            scale = np.median(np.abs(p), axis=1, keepdims=True) if self.scaled else np.ones((self.num_hashes, 1))
        return (p / np.where(scale == 0, 1e-8, scale)).astype(np.float32)

    @property
    def output_cols(self) -> list[str]:
        return [f"{self.output_prefix}_{k}" for k in range(len(self.bin_widths))]

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame with the bucket columns, also of a stream. A null or NaN input gives null buckets; bins beyond 32 bits are the outermost."""
        projections, widths, names = self.projections, self.bin_widths, self.output_cols

        @F.pandas_udf(f"struct<{', '.join(f'{n}: array<int>' for n in names)}>")
        def buckets(rows: pd.DataFrame) -> pd.DataFrame:
            x = rows.to_numpy(dtype=np.float32)
            dots = x @ projections.T
            whole = ~np.isnan(x).any(axis=1)
            out = {}
            for n, w in zip(names, widths):
                bins = np.clip(np.floor_divide(dots, np.float32(w)), INT.min, INT.max - 127)
                bins = np.where(np.isnan(bins), 0, bins).astype(np.int32)
                out[n] = pd.Series([b if ok else None for b, ok in zip(bins, whole)], index=rows.index, dtype=object)
            return pd.DataFrame(out)

        at = "__lsh_" + self.output_prefix
        made = df.withColumn(at, buckets(F.struct(*(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(self.input_cols)))))
        return made.select(*df.columns, *(F.col(at)[n].alias(n) for n in names))


class LSHSampler(MultiBucketLSH):
    """Buckets, their sizes, and samples that favour sparse (or dense) ones."""

    scaled = True

    def __init__(self, input_cols: list[str], num_hashes: int = 35, bin_widths: list[float] | None = None, random_proj: bool = False, seed: int | None = None, output_prefix: str = "bins"):
        if not bin_widths:
            raise ValueError("bin_widths must not be empty")
        super().__init__(input_cols, num_hashes, bin_widths, random_proj, seed, output_prefix)

    def _keyed(self, df: DataFrame, bin_width_idx: int) -> DataFrame:
        if not 0 <= bin_width_idx < len(self.bin_widths):
            raise ValueError("there is no such bin width")
        return self.transform(df).withColumn("bucket_key", F.concat_ws("|", self.output_cols[bin_width_idx]))

    def compute_bucket_sizes(self, df: DataFrame, bin_width_idx: int = 0) -> DataFrame:
        """(bucket_key, bucket_size)."""
        return self._keyed(df, bin_width_idx).groupBy("bucket_key").agg(F.count("*").alias("bucket_size"))

    def add_density_weights(self, df: DataFrame, inverse_density: bool = True, bin_width_idx: int = 0, eps: float = 1e-10) -> DataFrame:
        """The frame with bucket columns, bucket_key, bucket_size and weight: 1 / (size + eps), or the size.

        The sizes are counted before the shuffle and joined back, so a bucket that holds most rows is no single task's.
        """
        return self._weighted(df, inverse_density, bin_width_idx, eps)[0]

    def _weighted(self, df: DataFrame, inverse_density: bool, bin_width_idx: int, eps: float = 1e-10) -> tuple[DataFrame, DataFrame]:
        """The weighted rows and the buckets' sizes. The buckets are written once, so the projections are worked out once."""
        keyed = Workspace(df.sparkSession).keep(self._keyed(df, bin_width_idx), "keyed")
        sizes = keyed.groupBy("bucket_key").agg(F.count("*").alias("bucket_size"))
        weight = 1.0 / (F.col("bucket_size") + eps) if inverse_density else F.col("bucket_size").cast("double")
        return keyed.join(sizes, "bucket_key").withColumn("weight", weight), sizes

    def sample(self, df: DataFrame, n_samples: int, inverse_density: bool = True, bin_width_idx: int = 0) -> DataFrame:
        """About ``n_samples`` rows: each of a bucket is taken with min((bucket's weight / all weight) * n_samples / size, 1)."""
        weighted, sizes = self._weighted(df, inverse_density, bin_width_idx)
        share = F.lit(1.0) if inverse_density else F.col("bucket_size") * F.col("bucket_size")
        total = sizes.agg(F.sum(share)).first()[0] or 1.0
        # the weights of a bucket's rows add up to 1, or to the square of its size
        fraction = F.least(F.lit(1.0), share / total * n_samples / F.col("bucket_size"))
        return weighted.where(F.rand(self.seed if self.seed is not None else 42) < fraction).drop("weight", "bucket_size", "bucket_key")


def bucket_crosstab(df: DataFrame, wide: str = "bins_1", narrow: str = "bins_0") -> DataFrame:
    """The frame with ``narrow_count``: how many different narrow buckets the row's wide bucket is cut into."""
    counts = df.groupBy(wide).agg(F.count_distinct(narrow).alias("narrow_count"))
    return df.join(counts, wide)
