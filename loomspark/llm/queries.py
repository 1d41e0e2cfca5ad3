"""The queries of this subpackage and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.top_n import top_n_by_group

    return top_n_by_group(_table(spark, sf_dir, "knn_candidates"), 5, at_least=0.0).select("index_test", "index_train")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.vectors import nearest_vectors

    return nearest_vectors(_table(spark, sf_dir, "knn_test"), _table(spark, sf_dir, "knn_train"), 10, dim=32).select("index_test", "index_train")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.clusters import similarity_clusters

    found = similarity_clusters(_table(spark, sf_dir, "hiclust_points"), dim=8, radius=0.5)
    return found.where("cluster_size > 1").select("index_train", "cluster_min")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.clusters import describe_clusters, similarity_clusters

    return describe_clusters(similarity_clusters(_table(spark, sf_dir, "hiclust_points"), dim=8, radius=0.5))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.links import consolidate

    pairs = _table(spark, sf_dir, "stack_pairs").where((F.col("distance") >= 0) & (F.col("distance") <= 0.25) & ~F.isnan("distance"))
    return consolidate(pairs)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "lshp_points")
    cell = F.concat_ws("|", *(F.round(F.col(f"x{k}") * 2).cast("int") for k in range(1, 16)))
    hint = F.when((F.col("weight") > 0) & (F.col("weight") <= 1), F.col("weight")).otherwise(0.0)
    return points.select(
        "point_id",
        F.regexp_replace("bucket_key", r"\s+", "").alias("bucket"),
        F.concat_ws("|", "bins_1").alias("wide"),
        cell.alias("cell"),
        (0.75 + 0.25 * hint).alias("mass"),
    )


def p5_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the points."""
    from loomspark.llm.subset import varied_subset

    return varied_subset(_points(spark, sf_dir), share=0.1, id="point_id", features=["bucket", "wide", "cell"], mass="mass")


def p5_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5,000 points, whatever the table's size."""
    from loomspark.llm.subset import varied_subset

    return varied_subset(_points(spark, sf_dir), 5000, id="point_id", features=["bucket", "wide", "cell"], mass="mass")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), 2048)


def p8_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 256 tokens that hold reviews of one item only: with few documents to choose from, best-fit isn't enough."""
    from loomspark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), 256, by="item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.leakage import leaked_items

    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.residue import residue

    return residue(_table(spark, sf_dir, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p5_subset": p5_subset, "p5_fixed": p5_fixed, "p8_containers": p8_containers, "p8_by_item": p8_by_item, "p9_found": p9_found, "p10_found": p10_found}


_USABLE = "features IS NOT NULL AND len(features) = {} AND len(list_filter(features, lambda x: x IS NULL OR isnan(x))) = 0"

SQL = {
    "p2_found": f"""
        WITH q AS (SELECT index_test, min(features) AS f FROM knn_test WHERE index_test IS NOT NULL AND {_USABLE.format(32)} GROUP BY index_test),
        t AS (SELECT index_train, min(features) AS f FROM knn_train WHERE index_train IS NOT NULL AND {_USABLE.format(32)} GROUP BY index_train)
        SELECT index_test, index_train FROM q, t
        QUALIFY row_number() OVER (PARTITION BY index_test ORDER BY list_distance(q.f, t.f), index_train) <= 10""",
    "p3_found": f"""
        WITH p AS (SELECT index_train, min(features) AS f FROM hiclust_points WHERE index_train IS NOT NULL AND {_USABLE.format(8)} GROUP BY index_train)
        SELECT a.index_train, min(b.index_train) AS cluster_min FROM p a JOIN p b ON b.f[1] BETWEEN a.f[1] - 0.5 AND a.f[1] + 0.5
        WHERE list_distance(a.f, b.f) <= 0.5 GROUP BY a.index_train HAVING count(*) > 1""",
    "p1_found": """
        WITH best AS (
            SELECT index_test, index_train, min(distance) AS distance FROM knn_candidates
            WHERE index_test IS NOT NULL AND index_train IS NOT NULL AND isfinite(distance) AND distance >= 0
            GROUP BY ALL)
        SELECT index_test, index_train FROM best
        QUALIFY row_number() OVER (PARTITION BY index_test ORDER BY distance, index_train) <= 5""",
    "p4_found": """
        WITH RECURSIVE m AS (
            SELECT DISTINCT least(id_a, id_b) AS a, greatest(id_a, id_b) AS b FROM stack_pairs
            WHERE id_a <> id_b AND distance BETWEEN 0 AND 0.25 AND NOT isnan(distance)),
        e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
        r(id, g) USING KEY (id) AS (
            SELECT a, min(least(a, b)) FROM e GROUP BY a
            UNION
            SELECT e.a, min(n.g) FROM r AS n JOIN e ON e.b = n.id JOIN recurring.r AS o ON o.id = e.a WHERE n.g < o.g GROUP BY e.a)
        SELECT id, g AS group_id FROM r""",
}
