"""The queries of the core operators and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# list problems of the core


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.hierarchy import hierarchy

    return hierarchy(table(spark, sf_dir, "hn_items")).select("id", "root_id")


def p6_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.hierarchy import hierarchy

    return hierarchy(table(spark, sf_dir, "hn_items"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.hierarchy import hierarchy, paths

    return paths(hierarchy(table(spark, sf_dir, "hn_items")), loops=True)


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.hierarchy import descendants, hierarchy

    return descendants(hierarchy(table(spark, sf_dir, "hn_items")), loops=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.skew import heavy_keys

    return heavy_keys(table(spark, sf_dir, "lshp_points"), 0.025).select("bucket_key")


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.skew import bucket_totals

    return bucket_totals(table(spark, sf_dir, "lshp_points")).withColumn("total_weight", F.round("total_weight", 6))


def p7_above_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key the points whose weight is above its mean: the points are split over shards, the means replicated to these."""
    from loomspark.operators.skew import bucket_totals, fragment_replicate_join

    points = table(spark, sf_dir, "lshp_points")
    means = bucket_totals(points).where("weighted > 0").select("bucket_key", (F.col("total_weight") / F.col("weighted")).alias("mean"))
    key = F.regexp_replace("bucket_key", r"[\s\x{00a0}]+", "").alias("bucket_key")
    rows = points.select(key, "point_id", F.col("weight").cast("double").alias("w")).where("bucket_key IS NOT NULL AND point_id IS NOT NULL AND w > 0 AND NOT isnan(w)")
    joined = fragment_replicate_join(rows, means, "bucket_key", ["point_id"])
    # a point's rows are in one shard, and few, so the last count has one row for each point and key to merge at most
    above = joined.groupBy("bucket_key", "point_id").agg(F.max(F.col("w") - F.col("mean")).alias("over")).where("over > 1e-9")
    return above.groupBy("bucket_key").agg(F.count("*").alias("above"))


# nearest neighbours


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(DIM)), "label")


def _knn(metric: str, weighted: bool, regress: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from loomspark.operators.knn import KNN

        rows = _vectors(spark, sf_dir).withColumnRenamed("label", "y")
        if regress:
            rows = rows.withColumn("y", F.col("y").cast("double"))
        # every twentieth row asks, all rows but itself may answer
        train = rows.withColumnRenamed("vec_id", "index_train")
        test = rows.where("vec_id % 20 = 0").drop("y").withColumnRenamed("vec_id", "index_test")
        out = KNN(train).fit().predict(test, n_neighbors=10, metric=metric, weighted=weighted, leave_out_self=True)
        return out.withColumn("y", F.round("y", 6)) if regress else out.withColumn("metric", F.round("metric", 6)) if weighted else out

    return query


_DISTANCES = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "manhattan": "list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2])))",
    "cosine": "1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))",
}


def _knn_sql(metric: str, weighted: bool, regress: bool) -> str:
    w = "CASE WHEN d = 0 THEN 1.0 ELSE 1 / (d * d) END" if weighted else "1.0"
    near = f"""
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
        d AS (SELECT a.vec_id AS index_test, b.label AS y, {_DISTANCES[metric]} AS d
              FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        n AS (SELECT *, {w} AS w FROM d QUALIFY rank() OVER (PARTITION BY index_test ORDER BY round(d, 9)) <= 10)"""
    if regress:
        return near + " SELECT index_test, round(sum(y * w) / sum(w), 6) AS y FROM n GROUP BY index_test"
    votes = "round(sum(w), 6)" if weighted else "count(*)"
    return near + f"""
        SELECT index_test, y, metric FROM (
            SELECT index_test, y, {votes} AS metric,
                   row_number() OVER (PARTITION BY index_test ORDER BY round(sum(w), 9) DESC, y) AS r FROM n GROUP BY index_test, y)
        WHERE r = 1"""


# similarity, clustering and their quality


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.similarity import SimilarityMatrix

    return SimilarityMatrix.of_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").create_sim_matrix("euclidean", most=1.2)


def sim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs up to 1.2 apart (about one in a hundred)."""
    return _matrix(spark, sf_dir).withColumn("distance", F.round("distance", 6))


def degree_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.similarity import degree_normalized

    return degree_normalized(_matrix(spark, sf_dir), "vec_id", 0.3).withColumn("distance", F.round("distance", 6))


_PAIRS = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
    m AS (SELECT a.vec_id AS "vec_id_A", b.vec_id AS "vec_id_B", {_DISTANCES["euclidean"]} AS distance, a.label AS la, b.label AS lb
          FROM v a, v b WHERE a.vec_id < b.vec_id),
    k AS (SELECT * FROM m WHERE distance <= 1.2)"""


def cluster_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.cluster import HiClust

    rows = _vectors(spark, sf_dir).drop("label").withColumnRenamed("vec_id", "index_train")
    return HiClust(rows).fit(distance_threshold=1.1, max_iterations=1).get_clusters()


def cluster_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's cluster at each level, until nothing merges or the default number of rounds is over."""
    from loomspark.operators.cluster import HiClust

    rows = _vectors(spark, sf_dir).drop("label").withColumnRenamed("vec_id", "index_train")
    return HiClust(rows).fit(distance_threshold=1.1).combine_cluster_iterations()


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(spark, sf_dir).withColumnRenamed("label", "cluster")
    return rows, rows.groupBy("cluster").agg(*(F.avg(f"x{k}").alias(f"x{k}") for k in range(DIM)))


def cluster_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.quality import Indices

    rows, centroids = _labelled(spark, sf_dir)
    s = Indices([f"x{k}" for k in range(DIM)]).squares(rows, centroids)
    return s.select("cluster", "n", F.round("wss", 6).alias("wss"), F.round("bss", 6).alias("bss"))


def cluster_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.quality import Indices

    rows, centroids = _labelled(spark, sf_dir)
    got = Indices([f"x{k}" for k in range(DIM)]).compute_indices(rows, centroids)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in got.items()], "name string, value double")


def _modularity(form: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from loomspark.operators.community import modularity_frame

        labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
        return modularity_frame(_matrix(spark, sf_dir), labels, a="vec_id_A", b="vec_id_B", item="vec_id", community="label", form=form).select(F.round("modularity", 8).alias("modularity"))

    return query


_MODULARITY = f"""WITH {_PAIRS},
    w AS (SELECT "vec_id_A" AS a, "vec_id_B" AS b, la, lb, 1 / (1 + distance) AS w FROM k),
    s AS (SELECT x, any_value(l) AS l, sum(w) AS k FROM (SELECT a AS x, la AS l, w FROM w UNION ALL SELECT b, lb, w FROM w) GROUP BY x),
    t AS (SELECT 2 * sum(w) AS m2, 2 * sum(CASE WHEN la = lb THEN w ELSE 0 END) AS inside FROM w),"""


# normalisation


def _normalize(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from loomspark.operators.normalize import Normalizer

        rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
        out = Normalizer(method, ["l_quantity", "l_extendedprice"]).fit_transform(rows)
        return out.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})

    return query


def _normalize_sql(method: str) -> str:
    form = {
        "minmax": "({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)",
        "zscore": "({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem)",
        "range": "({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)",
    }[method]
    cols = ", ".join(f"round({form.format(c=c)}, 6) AS {c}" for c in ("l_quantity", "l_extendedprice"))
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem"


# locality-sensitive hashing


def _sampler():
    from loomspark.functions.lsh import LSHSampler

    return LSHSampler([f"x{k}" for k in range(DIM)], num_hashes=2, bin_widths=[0.5, 1.0, 2.0], random_proj=True, seed=42)


def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler().transform(_vectors(spark, sf_dir)).select("vec_id", "bins_0", "bins_1", "bins_2")


def lsh_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler().compute_bucket_sizes(_vectors(spark, sf_dir))


def lsh_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sampler().add_density_weights(_vectors(spark, sf_dir), bin_width_idx=1)
    return out.select("vec_id", "bucket_key", "bucket_size", F.round("weight", 6).alias("weight"))


def lsh_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler().sample(_vectors(spark, sf_dir), 200).select("vec_id", "bins_0")


def lsh_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.functions.lsh import bucket_crosstab

    return bucket_crosstab(lsh_buckets(spark, sf_dir)).select("vec_id", "narrow_count")


def _bins_sql() -> str:
    s = _sampler()
    dots = ", ".join(f"list_dot_product(embedding::DOUBLE[], {[float(x) for x in p]}::DOUBLE[])" for p in s.projections)
    cols = ", ".join(f"list_transform([{dots}], lambda d: floor(d / {w})::INTEGER) AS bins_{k}" for k, w in enumerate(s.bin_widths))
    return f"b AS (SELECT vec_id, {cols} FROM embeddings)"


# graphs: customers, their orders' line items and the suppliers that deliver


def _graph(spark: SparkSession, sf_dir: str):
    from loomspark.graph import GraphFrame

    e = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.groupBy((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return GraphFrame(c.unionByName(s), e)


_GRAPH = """e AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    v AS (SELECT c_custkey * 2 AS id, c_name AS name, c_nationkey AS nation FROM customer
          UNION ALL SELECT s_suppkey * 2 + 1, s_name, s_nationkey FROM supplier)"""


def _trade(spark: SparkSession, sf_dir: str):
    """The same customers and suppliers, with an edge to the supplier for what was bought and one back for what was returned."""
    from loomspark.graph import GraphFrame

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, d = (F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")
    bought = lines.select(c, d)
    returned = lines.where("l_returnflag = 'R'").select((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("o_custkey") * 2).alias("dst"))
    return GraphFrame(_graph(spark, sf_dir).vertices, bought.unionByName(returned).distinct())


def _domestic(spark: SparkSession, sf_dir: str):
    """The trade between customers and suppliers of one nation."""
    from loomspark.graph import GraphFrame

    g = _trade(spark, sf_dir)
    nation = g.vertices.select("id", "nation")
    e = g.edges.join(nation.withColumnsRenamed({"id": "src", "nation": "a"}), "src").join(nation.withColumnsRenamed({"id": "dst", "nation": "b"}), "dst")
    return GraphFrame(g.vertices, e.where("a = b").select("src", "dst"))


def _baskets(spark: SparkSession, sf_dir: str):
    """Parts that stand in one order, once for each order: an order has a few line items, so it has a few pairs."""
    from loomspark.graph import GraphFrame

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = lines.join(lines.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst")
    return GraphFrame(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), pairs)


_TRADE = """v AS (SELECT c_custkey * 2 AS id, c_name AS name, c_nationkey AS nation FROM customer
          UNION ALL SELECT s_suppkey * 2 + 1, s_name, s_nationkey FROM supplier),
    e AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          UNION SELECT l_suppkey * 2 + 1, o_custkey * 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""
_DOMESTIC = f"{_TRADE}, d AS (SELECT src, dst FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.nation = b.nation)"


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.degrees.join(g.inDegrees, "id", "left").join(g.outDegrees, "id", "left").select("id", "degree", F.coalesce("inDegree", F.lit(0)).alias("inDegree"), F.coalesce("outDegree", F.lit(0)).alias("outDegree"))


def graph_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).triplets.select(F.col("src.id").alias("a"), F.col("dst.id").alias("b"), F.col("src.name").alias("a_name"), F.col("dst.name").alias("b_name"), F.col("edge.n").alias("n"))


def graph_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir).filterVertices("nation < 12").filterEdges("n > 1").dropIsolatedVertices()
    return g.vertices.select("id", "nation")


def graph_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.graph import AggregateMessages as AM

    return _graph(spark, sf_dir).aggregateMessages(F.sum(AM.msg).cast("long").alias("total"), sendToSrc=AM.dst["nation"], sendToDst=AM.src["nation"] * AM.edge["n"])


def graph_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _domestic(spark, sf_dir).find("(a)-[]->(b); (b)-[]->(c); !(a)-[]->(c)")
    return m.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("c.id").alias("c"))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).connectedComponents().select("id", "component")


def graph_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domestic(spark, sf_dir).stronglyConnectedComponents(20).select("id", "component")


def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).labelPropagation(2).select("id", "label")


def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).pageRank(maxIter=3).vertices.select("id", F.round("pagerank", 6).alias("pagerank"))


def graph_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _trade(spark, sf_dir).parallelPersonalizedPageRank(sourceIds=[2, 3], maxIter=3)
    return g.vertices.select("id", F.transform("pageranks", lambda x: F.round(x, 6)).alias("pageranks"))


def graph_pregel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.graph import Pregel

    p = _trade(spark, sf_dir).pregel.setMaxIter(4).withVertexColumn("low", F.col("id"), F.least(F.col("low"), Pregel.msg()))
    return p.sendMsgToDst(Pregel.src("low")).aggMsgs(F.min(Pregel.msg())).run().select("id", "low")


def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _trade(spark, sf_dir).shortestPaths([2, 3])
    return out.select("id", F.explode("distances").alias("landmark", "d"))


def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest ways from a customer to the customers of one nation, over suppliers that took goods back."""
    b = _trade(spark, sf_dir).bfs("id = 2", "nation = 3 AND id % 2 = 0 AND id <> 2")
    return b.select(F.col("from.id").alias("a"), F.col("v1.id").alias("b"), F.col("to.id").alias("c"))


def graph_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baskets(spark, sf_dir).triangleCount().select("id", "count")


def graph_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.graph import GraphFrame

    g = _graph(spark, sf_dir)
    v, _ = GraphFrame(g.vertices, g.edges.select("src", "dst", F.col("n").cast("double").alias("weight"))).svdPlusPlus(rank=4, maxIter=2)
    return v.select("id", F.round("column3", 6).alias("bias"))


def graph_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.graph.examples import belief_propagation, grid_ising_model

    return belief_propagation(grid_ising_model(spark, 10), 2).select("id", F.round("belief", 6).alias("belief"))


# batches and sampling


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.batches import BatchGenerator

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return BatchGenerator(spark, rows).split(256, "id", seed=1).groupBy("chunk").agg(F.count("*").alias("n"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.quality import Indices

    rows = _vectors(spark, sf_dir)
    return Indices(["x0"], "label").balanced_sample(rows, sample_size=10).select("vec_id", "label")


#: Every item with its way up: to a root, or to the first item on a loop and once round it.
_TREE = """WITH RECURSIVE n AS (SELECT id, min(CASE WHEN parent <> 0 AND parent IN (SELECT id FROM hn_items) THEN parent END) AS parent FROM hn_items WHERE id IS NOT NULL GROUP BY id),
    up(id, way, nxt) AS (SELECT id, [id], parent FROM n UNION ALL SELECT up.id, list_append(way, nxt), n.parent FROM up JOIN n ON n.id = up.nxt WHERE NOT list_contains(way, nxt)),
    ends AS (SELECT id, way, nxt FROM up QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(way) DESC) = 1),
    loops AS (SELECT id, way, nxt, CASE WHEN nxt IS NOT NULL THEN list_position(way, nxt) END AS enters FROM ends),
    placed AS (SELECT id, way, nxt, enters, nxt IS NOT NULL AS cyclic, CASE WHEN nxt IS NULL THEN list_reverse(way) ELSE list_reverse(way[1:enters]) END AS path,
                      CASE WHEN nxt IS NULL THEN way[-1] ELSE list_min(way[enters:]) END AS root_id FROM loops),
    spans AS (SELECT a AS id, count(*) AS span FROM (SELECT unnest(path) AS a FROM placed) GROUP BY a),
    rings AS (SELECT root_id, sum(span) AS whole FROM placed JOIN spans USING (id) WHERE cyclic AND enters = 1 GROUP BY root_id),
    tree AS (SELECT placed.id, n.parent, root_id, CASE WHEN NOT cyclic THEN CAST(len(path) - 1 AS BIGINT) END AS depth,
                    CAST(CASE WHEN enters = 1 THEN whole ELSE span END AS BIGINT) AS size, span, cyclic,
                    row_number() OVER (PARTITION BY cyclic, path[1] ORDER BY path) - 1 AS pre,
                    CASE WHEN cyclic THEN path[1] END AS loop_id, CAST(CASE WHEN enters = 1 THEN list_position(way, root_id) - 1 END AS BIGINT) AS loop_at
             FROM placed JOIN n USING (id) JOIN spans USING (id) LEFT JOIN rings USING (root_id))"""

_FORMS = [(m, w) for m in ("euclidean", "manhattan", "cosine") for w in (True, False)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {"knn_classify" + ("" if w else "_unweighted") + ("" if m == "euclidean" else f"_{m}"): _knn(m, w, False) for m, w in _FORMS}
    | {"knn_regress" + ("" if w else "_unweighted") + ("" if m == "euclidean" else f"_{m}"): _knn(m, w, True) for m, w in _FORMS}
    | {f"normalize_{m}": _normalize(m) for m in ("minmax", "zscore", "range")}
    | {"modularity_newman": _modularity("newman"), "modularity_linked": _modularity("linked_pairs")}
    | {
        f.__name__: f
        for f in (
            p6_found, p6_tree, p6_paths, p6_descendants, p7_found, p7_totals, p7_above_mean, sim_matrix, degree_norm, cluster_levels, cluster_history, cluster_squares, cluster_indices, lsh_buckets, lsh_bucket_sizes,
            lsh_weights, lsh_sample, lsh_crosstab, graph_degrees, graph_triplets, graph_filters, graph_messages, graph_motif, graph_components, graph_scc,
            graph_labels, graph_pagerank, graph_ppr, graph_pregel, graph_paths, graph_bfs, graph_triangles, graph_svd, graph_beliefs, batches, stratified_sample,
        )
    }
)

_RANK = "SELECT v.id, 0.15 + 0.85 * coalesce(sum(r.r * w.w), 0) AS r FROM v LEFT JOIN w ON w.dst = v.id LEFT JOIN {} r ON r.id = w.src GROUP BY v.id"
_COUNT = "SELECT id, CAST(count(*) AS INTEGER)"

SQL: dict[str, str] = (
    {"knn_classify" + ("" if w else "_unweighted") + ("" if m == "euclidean" else f"_{m}"): _knn_sql(m, w, False) for m, w in _FORMS}
    | {"knn_regress" + ("" if w else "_unweighted") + ("" if m == "euclidean" else f"_{m}"): _knn_sql(m, w, True) for m, w in _FORMS}
    | {f"normalize_{m}": _normalize_sql(m) for m in ("minmax", "zscore", "range")}
    | {
        "p7_found": """
            WITH c AS (SELECT regexp_replace(bucket_key, '\\s+', '', 'g') AS bucket_key, point_id FROM lshp_points
                       WHERE bucket_key IS NOT NULL AND point_id IS NOT NULL)
            SELECT bucket_key FROM c GROUP BY bucket_key
            HAVING count(DISTINCT point_id) >= 0.025 * (SELECT count(DISTINCT point_id) FROM c)""",
        "p7_totals": """
            WITH c AS (SELECT regexp_replace(bucket_key, '\\s+', '', 'g') AS bucket_key, point_id,
                              max(CASE WHEN weight > 0 AND NOT isnan(weight) THEN weight END) AS w
                       FROM lshp_points WHERE bucket_key IS NOT NULL AND point_id IS NOT NULL GROUP BY ALL)
            SELECT bucket_key, count(*) AS bucket_size, round(sum(w), 6) AS total_weight, count(w) AS weighted FROM c GROUP BY bucket_key""",
        "p7_above_mean": """
            WITH c AS (SELECT regexp_replace(bucket_key, '\\s+', '', 'g') AS bucket_key, point_id, max(weight::DOUBLE) AS w FROM lshp_points
                       WHERE bucket_key IS NOT NULL AND point_id IS NOT NULL AND weight > 0 AND NOT isnan(weight) GROUP BY ALL),
            m AS (SELECT bucket_key, sum(w) / count(*) AS mean FROM c GROUP BY bucket_key)
            SELECT bucket_key, count(*) AS above FROM c JOIN m USING (bucket_key) WHERE w - mean > 1e-9 GROUP BY bucket_key""",
        "sim_matrix": f'WITH {_PAIRS} SELECT "vec_id_A", "vec_id_B", round(distance, 6) AS distance FROM k',
        "degree_norm": f"""WITH {_PAIRS},
            n AS (SELECT x, 1 / sqrt(sum(distance)) AS d FROM (SELECT "vec_id_A" AS x, distance FROM k UNION ALL SELECT "vec_id_B", distance FROM k) GROUP BY x)
            SELECT "vec_id_A", "vec_id_B", round(distance * a.d * b.d, 6) AS distance FROM k JOIN n a ON a.x = "vec_id_A" JOIN n b ON b.x = "vec_id_B" """,
        "cluster_levels": f"""WITH RECURSIVE {_PAIRS},
            l AS (SELECT "vec_id_A" AS a, "vec_id_B" AS b FROM k WHERE distance <= 1.1 UNION ALL SELECT "vec_id_B", "vec_id_A" FROM k WHERE distance <= 1.1),
            r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b)
            SELECT id AS index_train, min(c) AS cluster FROM r GROUP BY id""",
        "cluster_squares": """
            WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
            c AS (SELECT label, k, avg(x) AS c FROM x GROUP BY ALL), m AS (SELECT k, avg(x) AS m FROM x GROUP BY k)
            SELECT label AS cluster, count(DISTINCT vec_id) AS n, round(sum((x - c) ** 2), 6) AS wss, round(sum((c - m) ** 2), 6) AS bss
            FROM x JOIN c USING (label, k) JOIN m USING (k) GROUP BY label""",
        "modularity_newman": f"{_MODULARITY} q AS (SELECT sum(k * k) AS kk FROM (SELECT l, sum(k) AS k FROM s GROUP BY l)) SELECT round((inside - kk / m2) / m2, 8) AS modularity FROM t, q",
        "modularity_linked": f"{_MODULARITY} q AS (SELECT 2 * sum(x.k * y.k) AS kk FROM w JOIN s x ON x.x = w.a JOIN s y ON y.x = w.b WHERE la = lb) SELECT round((inside - kk / m2) / m2, 8) AS modularity FROM t, q",
        "lsh_buckets": f"WITH {_bins_sql()} SELECT * FROM b",
        "lsh_bucket_sizes": f"WITH {_bins_sql()} SELECT array_to_string(bins_0, '|') AS bucket_key, count(*) AS bucket_size FROM b GROUP BY 1",
        "lsh_weights": f"""WITH {_bins_sql()}, k AS (SELECT vec_id, array_to_string(bins_1, '|') AS bucket_key FROM b)
            SELECT vec_id, bucket_key, count(*) OVER w AS bucket_size, round(1 / (count(*) OVER w + 1e-10), 6) AS weight FROM k WINDOW w AS (PARTITION BY bucket_key)""",
        "lsh_crosstab": f"WITH {_bins_sql()}, c AS (SELECT bins_1, count(DISTINCT bins_0) AS narrow_count FROM b GROUP BY bins_1) SELECT vec_id, narrow_count FROM b JOIN c USING (bins_1)",
        "graph_degrees": f"""WITH {_GRAPH}, d AS ({_COUNT} AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
            SELECT d.id, degree, coalesce(i."inDegree", 0) AS "inDegree", coalesce(o."outDegree", 0) AS "outDegree" FROM d LEFT JOIN ({_COUNT} AS "inDegree" FROM (SELECT dst AS id FROM e) GROUP BY id) i USING (id)
            LEFT JOIN ({_COUNT} AS "outDegree" FROM (SELECT src AS id FROM e) GROUP BY id) o USING (id)""",
        "graph_triplets": f"WITH {_GRAPH} SELECT src AS a, dst AS b, s.name AS a_name, d.name AS b_name, n FROM e JOIN v s ON s.id = src JOIN v d ON d.id = dst",
        "graph_filters": f"""WITH {_GRAPH}, f AS (SELECT src, dst FROM e JOIN v s ON s.id = src JOIN v d ON d.id = dst WHERE s.nation < 12 AND d.nation < 12 AND n > 1)
            SELECT id, nation FROM v WHERE id IN (SELECT src FROM f UNION SELECT dst FROM f)""",
        "graph_messages": f"""WITH {_GRAPH} SELECT id, CAST(sum(m) AS BIGINT) AS total FROM (
            SELECT src AS id, d.nation AS m FROM e JOIN v d ON d.id = dst UNION ALL SELECT dst, s.nation * n FROM e JOIN v s ON s.id = src) GROUP BY id""",
        "graph_motif": f"WITH {_DOMESTIC} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM d x JOIN d y ON x.dst = y.src WHERE NOT EXISTS (SELECT 1 FROM d z WHERE z.src = x.src AND z.dst = y.dst)",
        "graph_pagerank": f"""WITH {_GRAPH}, w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e),
            r0 AS (SELECT id, 1.0::DOUBLE AS r FROM v), r1 AS ({_RANK.format("r0")}), r2 AS ({_RANK.format("r1")}), r3 AS ({_RANK.format("r2")})
            SELECT id, round(r, 6) AS pagerank FROM r3""",
        "graph_pregel": f"WITH {_TRADE}, l0 AS (SELECT id, id AS low FROM v), " + ", ".join(f"l{k + 1} AS (SELECT v.id, least(v.low, min(s.low)) AS low FROM l{k} v LEFT JOIN e ON e.dst = v.id LEFT JOIN l{k} s ON s.id = e.src GROUP BY v.id, v.low)" for k in range(4)) + " SELECT id, low FROM l4",
        "graph_labels": f"WITH {_TRADE}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT id, id AS label FROM v), " + ", ".join(f"""
            c{k} AS (SELECT dst AS id, label, count(*) AS n FROM b JOIN l{k} ON l{k}.id = src GROUP BY ALL),
            w{k} AS (SELECT id, label FROM c{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1),
            l{k + 1} AS (SELECT l{k}.id, coalesce(w{k}.label, l{k}.label) AS label FROM l{k} LEFT JOIN w{k} USING (id))""" for k in range(2)) + " SELECT id, label FROM l2",
        "graph_ppr": f"WITH {_TRADE}, w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e), r0 AS (SELECT id, k, CASE WHEN id = k THEN 1.0::DOUBLE ELSE 0 END AS r FROM v, (VALUES (2), (3)) t(k)), " + ", ".join(f"""
            r{k + 1} AS (SELECT a.id, a.k, CASE WHEN a.id = a.k THEN 0.15 ELSE 0 END + 0.85 * coalesce(sum(b.r * w.w), 0) AS r
                FROM r0 a LEFT JOIN w ON w.dst = a.id LEFT JOIN r{k} b ON b.id = w.src AND b.k = a.k GROUP BY a.id, a.k)""" for k in range(3)) + " SELECT id, [max(CASE WHEN k = 2 THEN round(r, 6) END), max(CASE WHEN k = 3 THEN round(r, 6) END)] AS pageranks FROM r3 GROUP BY id",
        "graph_bfs": f"""WITH {_TRADE}, t AS (SELECT id FROM v WHERE nation = 3 AND id % 2 = 0 AND id <> 2)
            SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN t ON t.id = y.dst
            WHERE x.src = 2 AND NOT EXISTS (SELECT 1 FROM e JOIN t ON t.id = e.dst WHERE e.src = 2)""",
        "graph_paths": f"""WITH RECURSIVE {_TRADE}, r(id, landmark, d) USING KEY (id, landmark) AS (
                SELECT id, id, 0 FROM v WHERE id IN (2, 3)
                UNION SELECT e.src, r.landmark, min(r.d) + 1 FROM r JOIN e ON e.dst = r.id LEFT JOIN recurring.r o ON o.id = e.src AND o.landmark = r.landmark
                WHERE o.id IS NULL GROUP BY e.src, r.landmark)
            SELECT id, landmark, d FROM r""",
        "graph_components": f"""WITH RECURSIVE {_TRADE}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
            r(id, c) USING KEY (id) AS (SELECT id, id FROM v
                UNION SELECT b.y, min(r.c) FROM r JOIN b ON b.x = r.id JOIN recurring.r o ON o.id = b.y WHERE r.c < o.c GROUP BY b.y)
            SELECT id, c AS component FROM r""",
        "graph_scc": f"""WITH RECURSIVE {_DOMESTIC}, r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, d.dst FROM r JOIN d ON d.src = r.b)
            SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
        "graph_triangles": """WITH e AS (SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey),
            t AS (SELECT p.x AS a, p.y AS b, q.y AS c FROM e p JOIN e q ON q.x = p.y JOIN e r ON r.x = p.x AND r.y = q.y),
            n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id)
            SELECT p_partkey AS id, coalesce(n, 0) AS count FROM part LEFT JOIN n ON id = p_partkey""",
        "p6_found": f"{_TREE} SELECT id, root_id FROM tree",
        "p6_tree": f"{_TREE} SELECT id, parent, root_id, depth, size, pre, pre + span - 1 AS last, cyclic, loop_id, loop_at FROM tree",
        "p6_paths": f"{_TREE} SELECT id, path FROM placed",
        "cluster_indices": """
            WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
            c AS (SELECT label, k, avg(x) AS c, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT k, avg(x) AS m FROM x GROUP BY k),
            t AS (SELECT sum((x - c) ** 2) AS wss, sum((c - m) ** 2) AS bss, count(DISTINCT vec_id)::DOUBLE AS n, count(DISTINCT label)::DOUBLE AS k FROM x JOIN c USING (label, k) JOIN m USING (k)),
            v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
            d AS (SELECT a.vec_id, a.label AS own, b.label, avg(list_distance(a.e, b.e) ** 2) AS far, sum(list_distance(a.e, b.e) ** 2) AS whole, count(*) AS n FROM v a, v b GROUP BY ALL),
            s AS (SELECT vec_id, max(CASE WHEN label = own THEN whole / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> own THEN far END) AS b FROM d GROUP BY vec_id)
            SELECT 'wss' AS name, round(wss, 6) AS value FROM t UNION ALL SELECT 'calinski_harabasz', round((bss / (k - 1)) / (wss / (n - k)), 6) FROM t
            UNION ALL SELECT 'wb_index', round(wss / bss, 6) FROM t UNION ALL SELECT 'xu_index', round(wss * ln(k) / n + k * ln(n), 6) FROM t
            UNION ALL SELECT 'silhouette', round(avg((b - a) / greatest(a, b)), 6) FROM s""",
        "batches": "SELECT CAST(floor((row_number() OVER () - 1) / 256) + 1 AS INTEGER) AS chunk, 1 AS one, c_custkey FROM customer",
    }
)
SQL["batches"] = f"SELECT chunk, count(*) AS n FROM ({SQL['batches']}) GROUP BY chunk"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
