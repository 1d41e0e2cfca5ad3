import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions.lsh import LSHSampler, MultiBucketLSH
from loomspark.operators.batches import BatchedStreamProcessor, BatchGenerator
from loomspark.operators.cluster import HiClust
from loomspark.operators.community import calculate_modularity
from loomspark.operators.knn import KNN
from loomspark.operators.normalize import Normalizer, NormalizerPandas
from loomspark.operators.quality import Indices
from loomspark.operators.similarity import SimilarityMatrix
from loomspark.operators.skew import bucket_totals, fragment_replicate_join, heavy_keys
from loomspark.session import Profile, partition_count, repartition_by_size
from loomspark.sources import io


def test_knn_ties_nulls_and_errors(spark):
    train = spark.createDataFrame([(i, float(i), y) for i, y in ((1, 0), (2, 1), (3, 1), (-3, 1), (9, 0))] + [(50, None, 1)], "index_train long, x double, y int")
    test = spark.createDataFrame([(0, 0.0), (1, None)], "index_test long, x double")
    model = KNN(train).fit()
    assert {r.index_train for r in model.neighbours(test, n_neighbors=3).collect()} == {1, 2, 3, -3}
    assert model.predict(test, n_neighbors=3).collect() == [(0, 0, 1.0)]
    assert model.predict(test, n_neighbors=3, weighted=False).collect() == [(0, 1, 3)]
    got = KNN(train.withColumn("y", F.col("y").cast("double"))).fit().predict(test, n_neighbors=1).collect()
    assert got == [(0, 0.0)]
    with pytest.raises(AttributeError):
        KNN(train, "z")
    with pytest.raises(AssertionError):
        KNN(train.withColumn("y", F.lit("a")))
    with pytest.raises(ValueError):
        KNN(train.union(train)).fit()
    with pytest.raises(AssertionError):
        model.predict(test, metric="none")
    assert model.predict(test.limit(0)).count() == 0


def test_similarity_and_degrees(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 1.0), (4, None, 1.0)], "id long, x double, y double")
    m = SimilarityMatrix(df)
    with pytest.raises(ValueError):
        m.create_degree_matrix()
    got = {(r.id_A, r.id_B): r.distance for r in m.prep().create_sim_matrix("euclidean").collect()}
    assert got == pytest.approx({(1, 2): 5.0, (1, 3): 1.0, (2, 3): math.sqrt(18)})
    n = {(r.id_A, r.id_B): r.distance for r in m.create_degree_matrix(2.0).collect()}
    assert n[(1, 2)] == pytest.approx(5 / math.sqrt(5 * (5 + math.sqrt(18))))


def test_blocks_of_both_sides(spark):
    """Several blocks give what one gives: neighbours, pairs, scaled pairs and the automatic threshold."""
    from loomspark.functions.distance import block_counts, nearest_in_blocks, own_blocks, pack

    rng = np.random.RandomState(2)
    x = rng.randn(150, 5)
    df = spark.createDataFrame([(i, *r.tolist()) for i, r in enumerate(x)], "id long, " + ", ".join(f"x{k} double" for k in range(5)))
    rows = pack(df, "id", [f"x{k}" for k in range(5)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = nearest_in_blocks(rows.where("id < 20"), rows, 3, "euclidean", "long", "long", rows=40).toPandas()
    got = {i: set(g.nsmallest(3, "distance").other) for i, g in near.groupby("id")}
    assert got == {i: set(np.argsort(d[i])[:3]) for i in range(20)}
    matrix = SimilarityMatrix(df).prep().create_sim_matrix("euclidean", most=2.0, block_rows=40).toPandas()
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 2.0}
    assert {(a, b) for a, b in zip(matrix.id_A, matrix.id_B)} == want and len(matrix) == len(want)
    assert np.allclose(matrix.distance, d[matrix.id_A, matrix.id_B])
    weighted = rows.withColumn("w", (F.col("id") % 3 + 1).cast("double"))
    w = np.arange(150) % 3 + 1.0
    scaled = d * 2 * np.minimum(w[:, None], w[None]) / (w[:, None] + w[None])
    upper = scaled[np.triu_indices(150, 1)]
    close = HiClust(df, "id")._close(weighted, "euclidean", 99.0, True, False, 40).toPandas()
    assert len(close) == (upper <= upper.mean() + 3 * upper.std(ddof=1)).sum() < len(upper)
    assert block_counts(10**9, 1000, 64, 200) == (7630, 1) and own_blocks(rows, 40).select("i", "j").distinct().count() == 10


def test_lsh_projections_are_drawn_once(spark):
    """The weights and the sample come from one run of the projections, and sizes agree with the buckets."""
    df = spark.range(200).select("id", F.rand(1).alias("x0"), F.rand(2).alias("x1"))
    s = LSHSampler(["x0", "x1"], num_hashes=2, bin_widths=[0.5], seed=1)
    rows = s.add_density_weights(df).toPandas()
    assert (rows.groupby("bucket_key").size()[rows.bucket_key].to_numpy() == rows.bucket_size).all() and len(rows) == 200


def test_silhouette_in_blocks(spark, monkeypatch):
    df = spark.range(60).select("id", (F.col("id") % 5).alias("cluster"), (F.col("id") % 5 + F.rand(3)).alias("x"))
    whole = Indices(["x"]).silhouette(df).first()[0]
    monkeypatch.setattr("loomspark.operators.quality.BLOCK_BYTES", 64)
    assert Indices(["x"]).silhouette(df).first()[0] == pytest.approx(whole)


def test_clustering_levels(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 0.05, 0.1, 5, 5.05, 9])], "index_train long, x double")
    c = HiClust(df)
    with pytest.raises(ValueError):
        c.get_clusters()
    assert {r.index_train: r.cluster for r in c.fit(distance_threshold=0.1).get_clusters().collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    top = HiClust(df).fit(distance_threshold=0.1, find_top_one=True)
    assert len({r.cluster for r in top.get_clusters().collect()}) == 3 and len(top.levels) == 2
    assert top.combine_cluster_iterations().columns == ["index_train", "cluster_id_0", "cluster_id_1", "cluster_id_2"]



def brute_levels(points, threshold, rounds=10):
    now, at, history = {i: (v, 1.0) for i, v in points.items()}, {i: i for i in points}, [{i: i for i in points}]
    for _ in range(rounds):
        group = {i: i for i in now}
        for a in sorted(now):
            for b in sorted(now):
                (x, m), (y, n) = now[a], now[b]
                if a < b and group[a] != group[b] and np.linalg.norm(x - y) * 2 * min(m, n) / (m + n) <= threshold:
                    low, high = sorted((group[a], group[b]))
                    group = {k: low if g == high else g for k, g in group.items()}
        if all(k == g for k, g in group.items()):
            break
        parts = {g: [now[k] for k in now if group[k] == g] for g in set(group.values())}
        now = {g: (np.mean([v for v, _ in p], axis=0), sum(w for _, w in p)) for g, p in parts.items()}
        at = {i: group[g] for i, g in at.items()}
        history.append(at)
    return history


def test_cluster_history_merges_past_the_first_round(spark, tmp_path):
    from loomspark.plans.catalog import queries

    x = [0.0, 0.6, 1.9, 4.0, 4.2, 9.0, 10.0, 11.7, 20.0]
    points = {i: np.r_[v, np.zeros(63)] for i, v in enumerate(x)}
    rows = [(i, v.tolist(), 0) for i, v in points.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_levels(points, 1.1)
    got = {r.index_train: list(r)[1:] for r in queries()["cluster_history"](spark, str(tmp_path)).collect()}
    assert len(want) > 2 and got == {i: [level[i] for level in want] for i in points}


def test_quality_golden(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.1, 2.1, 0), (5.0, 6.0, 1), (5.1, 6.1, 1)], "x double, y double, cluster int")
    centroids = spark.createDataFrame([(0, 1.05, 2.05), (1, 5.05, 6.05)], "cluster int, x double, y double")
    got = Indices(["x", "y"]).compute_indices(df, centroids)
    assert got == pytest.approx({"wss": 0.02, "calinski_harabasz": 3200.0, "wb_index": 0.000625, "xu_index": 2.776054458, "silhouette": 0.9993748047}, rel=1e-6)


def test_modularity_golden(spark):
    e = spark.createDataFrame([("A", "B", 1.0), ("A", "C", 0.5), ("B", "C", 0.7), ("B", "D", 0.3), ("C", "D", 0.6)], "itemA string, itemB string, distance double")
    c = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1), ("D", 1)], "item string, community int")
    q = lambda **k: calculate_modularity(e, c, **k)
    assert q(distance_type=None, form="newman") == pytest.approx(0.0078043705)
    assert q() == pytest.approx(0.1158353930) and q(form="newman") == pytest.approx(-0.1435465716)
    assert q(distance_type="cosine") == pytest.approx(-0.0415512465) and q(distance_type="cosine", form="newman") == pytest.approx(-0.3116343291)
    with pytest.raises(ValueError):
        calculate_modularity(e, c.where("item <> 'A'"))


@pytest.mark.parametrize("method", ["minmax", "zscore", "range"])
def test_normaliser_twins(spark, tmp_path, method):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 4.0], "b": [3.0, 3.0, 3.0], "c": [None, None, None]}).astype(float)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double")
    n = Normalizer(method, ["a", "b", "c"]).fit(df)
    n.save(str(tmp_path / "n.json"))
    twin = NormalizerPandas().load(str(tmp_path / "n.json"))
    got = n.transform(df).toPandas()
    np.testing.assert_allclose(got.astype(float), twin.transform(pdf).astype(float))
    np.testing.assert_allclose(got.astype(float), NormalizerPandas(method, ["a", "b", "c"]).fit_transform(pdf).astype(float))
    assert got["c"].isna().all()
    with pytest.raises(RuntimeError):
        Normalizer(method, ["a"]).transform(df)
    with pytest.raises(ValueError):
        Normalizer(method, ["z"]).fit(df)
    with pytest.raises(ValueError):
        Normalizer("none", ["a"])


def test_hashing(spark):
    df = spark.createDataFrame([(i, i / 10, -i / 7) for i in range(50)] + [(99, None, 1.0)], "id long, x double, y double")
    lsh = MultiBucketLSH(["x", "y"], num_hashes=3, bin_widths=[0.5, 2.0], random_proj=True, seed=1)
    row = {r.id: r for r in lsh.transform(df).collect()}
    x = np.array([2.0, -20 / 7], dtype=np.float32)
    assert row[20].bins_0 == np.floor(x @ lsh.projections.T / 0.5).astype(int).tolist() and row[99].bins_0 is None
    s = LSHSampler(["x", "y"], 2, [1.0], seed=1)
    assert s.compute_bucket_sizes(df).agg(F.sum("bucket_size")).first()[0] == 51
    assert s.add_density_weights(df).count() == 51 and s.sample(df, 20).columns == ["id", "x", "y", "bins_0"]
    with pytest.raises(ValueError):
        s.compute_bucket_sizes(df, 3)
    with pytest.raises(ValueError):
        LSHSampler(["x"], 0, [1.0])


def test_batches(spark):
    df = spark.range(100).select("id")
    adj = df.select(F.col("id").alias("id_A"), (F.col("id") + 1).alias("id_B"))
    got = list(BatchedStreamProcessor(2).batched_stream(BatchGenerator(spark, df, adj).get_df_generator(50, "id", 1, True)))
    assert [len(b) for _, b, _ in got] == [50, 50] and [e for e, _, _ in got] == [1, 1]
    assert sorted(i for _, b, _ in got for i in b["id"]) == list(range(100))
    assert all(set(p["id_A"]) | set(p["id_B"]) <= set(b["id"]) for _, b, p in got)
    assert list(BatchGenerator(spark, df.limit(0)).get_df_generator(5)) == []


def test_tables_and_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    io.save_table(df, "t_saved", partition_by="p")
    io.save_table(df.select("p", "k"), "t_saved", save_mode="append")
    assert io.read_table(spark, "t_saved").count() == 4
    with pytest.raises(AssertionError):
        io.save_table(df, "t_saved", save_mode="none")
    with pytest.raises(AttributeError):
        io.save_table(df, "t_saved", partition_by=["z"])
    assert io.merge_tree_options(["a", "b"])["createTableOptions"] == "engine=MergeTree() order by (a, b)"
    io.publish(df, "t_published")
    assert spark.table("global_temp.t_published").count() == 2
    assert Profile().shuffle_partitions == 1300 and Profile(dynamic=True).conf()["spark.dynamicAllocation.maxExecutors"] == "100"
    assert partition_count(0) == 1 and partition_count(10 * 2**27, "memory") == 10
    assert repartition_by_size(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        partition_count(1, compression=0.5)


def test_skewed_keys(spark):
    rows = [("a", i, 0.5) for i in range(300)] + [(" b ", 300 + i, None) for i in range(30)] + [("b", 300, -1.0), ("a", 0, 0.7), (None, 1, 1.0), ("c", None, 1.0), ("c", 500, float("nan"))]
    df = spark.createDataFrame(rows, "bucket_key string, point_id long, weight double").withColumn("w", F.lit(1))
    got = {r.bucket_key: tuple(r)[1:] for r in bucket_totals(df, tasks=5).collect()}
    assert got["a"] == (300, pytest.approx(150.2), 300) and got["b"] == (30, None, 0) and got["c"] == (1, None, 0)
    assert {r.bucket_key for r in heavy_keys(df, 0.05).collect()} == {"a", "b"}
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "bucket_key string, weight int")
    joined = fragment_replicate_join(df, right, "bucket_key", ["point_id"], tasks=5)
    assert joined.groupBy("bucket_key").count().orderBy("bucket_key").collect() == [("a", 602), ("c", 2)] and "weight_right" in joined.columns
    assert bucket_totals(df.limit(0)).count() == 0
