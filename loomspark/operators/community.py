"""Modularity of communities over weighted pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_weight(distance: Column | str, distance_type: str | None) -> Column:
    """euclidean: 1 / (1 + max(d, 0)); cosine: (1 - d) / 2 with d within -1 to 1; None: d itself."""
    d = F.col(distance).cast("double") if isinstance(distance, str) else distance
    if distance_type is None:
        return d
    if distance_type == "euclidean":
        return 1.0 / (1.0 + F.greatest(d, F.lit(0.0)))
    if distance_type == "cosine":
        return (1.0 - F.least(F.greatest(d, F.lit(-1.0)), F.lit(1.0))) / 2.0
    raise ValueError(f"distance_type must be euclidean, cosine or None, not {distance_type!r}")


def modularity_frame(edges: DataFrame, communities: DataFrame, *, a: str = "itemA", b: str = "itemB", distance: str = "distance", item: str = "item", community: str = "community", distance_type: str | None = "euclidean", weight_transform=None, form: str = "linked_pairs") -> DataFrame:
    """One row (modularity). linked_pairs: expected weights over linked pairs only; newman: over all pairs. 0 where there is no weight.

    A pair counts once, in whichever order it is given (of several the one of least weight). Null ends and distances are left out.
    """
    if form not in ("linked_pairs", "newman"):
        raise ValueError("form must be linked_pairs or newman")
    w = weight_transform(F.col(distance)) if weight_transform else edge_weight(distance, distance_type)
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), w.alias("w"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")).where("ok AND a <> b AND w IS NOT NULL")
    e = e.groupBy("a", "b").agg(F.min("w").alias("w"))
    c = communities.select(F.col(item).alias("x"), F.col(community).alias("c")).distinct()
    named = e.join(c.select(F.col("x").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("x").alias("b"), F.col("c").alias("cb")), "b")
    strength = e.select(F.explode(F.array("a", "b")).alias("x"), "w").groupBy("x").agg(F.sum("w").alias("k"))
    # every edge stands for two entries of the symmetric matrix
    inside = named.agg((2 * F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))), F.lit(0.0))).alias("inside"))
    total = e.agg((2 * F.coalesce(F.sum("w"), F.lit(0.0))).alias("m2"))
    if form == "newman":
        expected = strength.join(c, "x").groupBy("c").agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)).alias("kk"))
    else:
        with_k = named.where("ca = cb").join(strength.select(F.col("x").alias("a"), F.col("k").alias("ka")), "a").join(strength.select(F.col("x").alias("b"), F.col("k").alias("kb")), "b")
        expected = with_k.agg((2 * F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0.0))).alias("kk"))
    one = F.broadcast(inside).join(F.broadcast(total)).join(F.broadcast(expected))
    q = F.try_divide(F.col("inside") - F.try_divide(F.col("kk"), F.col("m2")), F.col("m2"))
    return one.select(F.coalesce(q, F.lit(0.0)).alias("modularity"))


def calculate_modularity(edges: DataFrame, communities: DataFrame, *, check_nodes: bool = True, **options) -> float:
    """The value of :func:`modularity_frame`; nodes without a community and negative weights raise ``ValueError``."""
    a, b = options.get("a", "itemA"), options.get("b", "itemB")
    if check_nodes:
        known = communities.select(F.col(options.get("item", "item")).alias("x"))
        if not edges.select(F.explode(F.array(a, b)).alias("x")).where("x IS NOT NULL").join(known, "x", "left_anti").isEmpty():
            raise ValueError("an edge's node has no community")
    transform, d = options.get("weight_transform"), options.get("distance", "distance")
    w = transform(F.col(d)) if transform else edge_weight(d, options.get("distance_type", "euclidean"))
    if not edges.where(w < 0).isEmpty():
        raise ValueError("weights must not be negative")
    return modularity_frame(edges, communities, **options).first()[0]
