import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm.clusters import Leaves, Verifier, band_keys, describe_clusters, least_jaccard, similarity_clusters
from loomspark.llm.leakage import Anchors, _candidates, holds, leaked_items
from loomspark.llm.links import consolidate
from loomspark.llm.packing import DEFAULT_TOKENIZER, best_fit, complete, dominates, least_containers, pack_documents
from loomspark.llm.phrases import seed_texts
from loomspark.llm.residue import Models, fields, residue, without_residue
from loomspark.llm.subset import varied_subset
from loomspark.llm.text import words
from loomspark.llm.top_n import cluster_by_group, top_n_by_group, top_n_of_clustered
from loomspark.llm.vectors import HashTree, nearest_vectors

NAN, INF = float("nan"), float("inf")


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.randint(0, 40) / 4) for i in range(500)] + [(g, i, rng.randint(0, 9) / 4) for g in range(1, 20) for i in range(g % 4)]
    rows += [(0, 3, 0.0), (0, 3, 9.0), (None, 1, 0.0), (1, None, 0.0), (1, 9, NAN), (1, 9, INF), (1, 9, -1.0), (1, 9, None)]
    df = spark.createDataFrame(rows, "index_test long, index_train long, distance double").withColumn("g", F.lit(1)).withColumn("rank", F.lit("x"))
    best = {}
    for g, i, d in rows:
        if None not in (g, i, d) and 0 <= d < INF:
            best[g, i] = min(d, best.get((g, i), INF))
    want = {}
    for (g, i), d in best.items():
        want.setdefault(g, []).append((d, i))
    want = {(g, r, i) for g, v in want.items() for r, (_, i) in enumerate(sorted(v)[:5], 1)}
    got = top_n_by_group(df, 5, at_least=0.0).collect()
    assert {(r.index_test, r["rank"], r.index_train) for r in got} == want and len(got) == len(want)
    assert top_n_by_group(df.limit(0), 5).count() == 0


def test_top_n_skips_files(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), F.rand(1).alias("s"))
    path = f"file://{tmp_path}/clustered"
    cluster_by_group(df, path, "g", "i", "s", partitions=3, file_rows=2_000)
    top, read = top_n_of_clustered(spark, path, 5)
    assert read["read"] < read["files"] / 2 and read["rows_read"] < read["rows"] / 2 and read["rows"] == 60_000
    want = df.groupBy("g").agg(F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 5).alias("s"))
    assert {(r.g, tuple(r.s)) for r in want.collect()} == {(r.g, tuple(r.s)) for r in top.groupBy("g").agg(F.sort_array(F.collect_list("s"), asc=False).alias("s")).collect()}


def test_links(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, i) for i in range(200, 260)]
    pairs += [(5, 5), (None, 3), (3, None), pairs[0], pairs[0][::-1], (9999, 9999)]
    group = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ga, gb = group.get(a, {a}), group.get(b, {b})
            both = ga | gb
            group |= dict.fromkeys(both, both)
    got = consolidate(spark.createDataFrame(pairs, "id_a long, id_b long").withColumn("id", F.lit(1)))
    assert {(r.id, r.group_id) for r in got.collect()} == {(i, min(g)) for i, g in group.items()} and got.count() == len(group)
    assert consolidate(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_links_of_long_chains_never_grow(spark):
    n = 100_000
    at = spark.range(n - 1)
    ordered = at.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    back = at.select((3 * n - F.col("id")).alias("id_a"), (3 * n - 1 - F.col("id")).alias("id_b"))
    place = lambda c: (c * 7919 + 13) % 100_003 + 10 * n
    shuffled = at.select(place(F.col("id")).alias("id_a"), place(F.col("id") + 1).alias("id_b"))
    log = []
    got = consolidate(ordered.unionByName(back).unionByName(shuffled), log=log).groupBy("group_id").count().collect()
    assert sorted((r.group_id, r["count"]) for r in got) == [(0, n), (2 * n + 1, n), (10 * n, n)]
    assert log[0] == 3 * (n - 1) and all(b < 0.75 * a + 20 for a, b in zip(log, log[1:])) and len(log) < 30


def test_nearest_vectors_recall(spark):
    rng = np.random.RandomState(3)
    centres = rng.randn(20, 32) * 4
    x = centres[rng.randint(0, 20, 3000)] + rng.randn(3000, 32) * 0.3
    q = centres[rng.randint(0, 20, 100)] + rng.randn(100, 32) * 0.3
    frame = lambda a, name, extra: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)] + extra, f"{name} long, features array<double>")
    bad = [(9001, None), (9002, [1.0]), (9003, [NAN] * 32), (None, [0.0] * 32), (0, x[0].tolist())]
    got = nearest_vectors(frame(q, "index_test", bad[:4]), frame(x, "index_train", bad), 10, dim=32, bucket_rows=200, sample_rows=800).toPandas()
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    want = {(i, int(j)) for i in range(100) for j in np.argsort(d[i])[:10]}
    assert len(want & set(zip(got.index_test, got.index_train))) >= 0.9 * len(want) and not got.duplicated(["index_test", "index_train"]).any()
    r = got[got.index_test == 0].sort_values("rank")
    assert np.allclose(r.distance, np.sqrt(d[0][r.index_train])) and r.distance.is_monotonic_increasing
    assert nearest_vectors(frame(q[:2], "index_test", []), frame(x, "index_train", []).limit(0), 10, dim=32).count() == 0


def test_nearest_vectors_of_small_buckets_and_few_rows(spark):
    """Buckets hashed on in turns keep their size, equal rows stay together, and every query has k neighbours."""
    rng = np.random.RandomState(8)
    x = np.vstack([rng.randn(4, 16)[rng.randint(0, 4, 2500)] * 3 + rng.randn(2500, 16) * 0.2, np.ones((400, 16))])
    q = np.vstack([x[:40] + rng.randn(40, 16) * 0.05, rng.randn(3, 16) * 50])
    frame = lambda a, name: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], f"{name} long, features array<double>")
    got = nearest_vectors(frame(q, "index_test"), frame(x, "index_train"), 10, dim=16, bucket_rows=60, sample_rows=60).toPandas()
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    want = {(i, int(j)) for i in range(43) for j in np.argsort(d[i], kind="stable")[:10]}
    assert len(got) == 430 and len(want & set(zip(got.index_test, got.index_train))) >= 0.85 * len(want)
    few = nearest_vectors(frame(q[:5], "index_test"), frame(x[:7], "index_train"), 10, dim=16, probes=1, bucket_rows=2).toPandas()
    assert len(few) == 35 and (few.groupby("index_test").index_train.nunique() == 7).all()


def test_hash_tree_of_equal_vectors():
    tree = HashTree(np.ones((500, 4)), 10, 1)
    rows, bucket = tree.probe(np.ones((3, 4)), 2)
    assert rows.tolist() == [0, 1, 2] and set(bucket) == {0}


def blobs(rng, n, radius, dim=8):
    out = []
    for centre in rng.randn(n, dim) * 20:
        for _ in range(rng.randint(1, 6)):
            v = rng.randn(dim)
            out.append(centre + v / np.linalg.norm(v) * radius * rng.rand())
    return np.array(out)


def test_clusters(spark):
    rng = np.random.RandomState(4)
    x = np.vstack([blobs(rng, 60, 0.24), np.tile(x0 := rng.randn(8), (5, 1)), x0 + rng.randn(300, 8) * 0.05])
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(7001, None), (7002, [NAN] * 8), (None, [0.0] * 8), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "index_train long, features array<double>").withColumn("v", F.lit(1))
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.25
    want = {(i, int(np.flatnonzero(near[i])[0])) for i in range(len(x))}
    for hot in (20_000, 50):  # the second splits the large buckets
        got = similarity_clusters(df, dim=8, radius=0.5, hot_rows=hot)
        assert {(r.index_train, r.cluster_min) for r in got.collect()} == want
    top = describe_clusters(got).orderBy(F.desc("cluster_size")).first()
    assert top.cluster_size == near.sum(axis=1).max() and len(top.typical) == 3
    assert similarity_clusters(df.limit(0), dim=8, radius=0.5).count() == 0


def test_loose_chain_is_split(spark):
    x = [[0.4 * i] + [0.0] * 7 for i in range(9)]
    df = spark.createDataFrame(list(enumerate(x)), "index_train long, features array<double>")
    got = similarity_clusters(df, dim=8, radius=0.5).collect()
    sizes = {r.cluster_min: r.cluster_size for r in got}
    assert len(got) == 9 and max(sizes.values()) <= 3 and sum(sizes.values()) == 9


def test_clusters_in_leaves_stars_and_bands(spark):
    rng = np.random.RandomState(6)
    ball, wide = rng.randn(200, 8) * 0.05, rng.randn(150, 8) * 0.16 + 40
    chain = np.arange(-60, 60)[:, None] * np.full(8, 0.1) + np.r_[30, np.zeros(7)]
    x = np.vstack([blobs(rng, 40, 0.24), ball, np.eye(8) * 0.7, wide, chain, rng.uniform(-9, 9, (60, 8))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "index_train long, features array<double>")
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.25
    label = np.arange(len(x))
    for _ in range(150):
        label = np.array([label[r].min() for r in near])
    whole = None
    for leaf, most in ((len(x), len(x)), (40, 100), (20, 21)):  # one leaf; leaves and stars; most records in shuffled bands too
        got = {(r.index_train, r.cluster_min, r.cluster_size, round(r.to_centre, 9)) for r in similarity_clusters(df, dim=8, radius=0.5, leaf_rows=leaf, most_rows=most, hot_rows=50).collect()}
        assert sorted(i for i, *_ in got) == list(range(len(x))) and all(label[i] == label[c] for i, c, *_ in got)
        assert got == (whole := whole or got)
    tight = {i for i in range(len(x)) if near[np.ix_(label == label[i], label == label[i])].all()}
    assert len(tight) > 300 and {(i, c) for i, c, *_ in whole if i in tight} == {(i, label[i]) for i in tight}


def test_leaves_bring_near_records_together():
    rng = np.random.RandomState(8)
    x = np.vstack([rng.randn(3000, 3) * 4, rng.randn(900, 3) * 0.2, rng.randn(900, 3) * 0.05 + 3])
    ids = np.arange(len(x)) * 7
    leaves = Leaves(ids, x, 1.0, 100, 300, 0.3)
    row, unit, home, star, copied = leaves.route(ids, x)
    assert leaves.units > 10 and leaves.pid and leaves.banded and sorted(row[home]) == list(range(len(x)))
    assert (copied == (np.bincount(row)[row] > 1)).all() and len(row) < 2 * len(x)
    units = [set() for _ in x]
    for r, u, s in zip(row, unit, star):
        units[r].add((u, s) if u < 0 or s == -1 else (u, "star"))
    own = {r: leaves.pid[s] for r, s in zip(row, star) if s >= 0}
    i, j = np.nonzero(np.triu(((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.09, 1))
    assert len(i) > 1000 and all(units[a] & units[b] or own.get(a, -1) == own.get(b, -2) for a, b in zip(i, j))


def test_clusters_write_a_vector_few_times(spark):
    """12 bands with the vectors took more than all the disk that the table's size allows."""
    rng = np.random.RandomState(9)
    x = np.repeat(rng.uniform(-90, 90, (4000, 8)), 5, axis=0) + rng.randn(20_000, 8) * 0.04
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "index_train long, features array<double>")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    written = lambda: sum(p.stat().st_size for p in Path(root).rglob("*.parquet"))
    before = written()
    got = similarity_clusters(df, dim=8, radius=0.5).where("cluster_size = 5")
    assert got.count() == len(x) and written() - before < 3 * x.nbytes


def test_least_jaccard_bounds_the_similarity():
    rng = np.random.RandomState(5)
    for _ in range(50):
        a, v = rng.randn(8) * 5, rng.randn(8)
        b = a + v / np.linalg.norm(v) * 0.5
        cells = [np.floor((p[:, None] + np.arange(16) * 2 / 16) / 2).ravel() for p in (a, b)]
        common = (cells[0] == cells[1]).sum()
        assert common / (256 - common) >= least_jaccard(0.5, 8, 2.0, 16)
        check = Verifier(8, 0.5, 2.0, 16)
        assert np.isclose(check.jaccard(check.lattice(a[None]), check.lattice(b[None]))[0], common / (256 - common))
    assert (band_keys(np.array([a, a]), 2.0, 16)[0] == band_keys(np.array([a, a]), 2.0, 16)[1]).all()


def test_varied_subset(spark):
    rows = [(i, "big", i) for i in range(900)] + [(1000 + i, f"s{i % 30}", i) for i in range(90)] + [(None, "x", 1), (5, "big", 5), (2000, None, None)]
    df = spark.createDataFrame(rows, "id long, bucket string, cell int").withColumn("m", F.when(F.col("id") == 3, NAN).when(F.col("id") == 4, -1.0))
    log = []
    got = varied_subset(df, 40, id="id", features=["bucket"], mass="m", log=log)
    chosen = df.dropDuplicates(["id"]).join(got, "id").groupBy("bucket").count().collect()
    count = {r.bucket: r["count"] for r in chosen}
    assert sum(count.values()) == 40 and len(count) == 31 and max(count.values()) <= 3
    # the first round takes one of each bucket; the gains of a second one are lower by a factor of 2 ** 0.5 - 1
    assert [x["added"] for x in log][0] == 31 and len(log) >= 2
    assert all(b["threshold"] < a["threshold"] for a, b in zip(log, log[1:])) and sum(x["added"] for x in log) == 40
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = varied_subset(df.repartition(5), 40, id="id", features=["bucket"], mass="m").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.id for r in got.collect()} == {r.id for r in again} and all(r.gain > 0 for r in again)
    assert varied_subset(df, share=1.0, id="id", features=["bucket", "cell"]).count() == 991
    assert varied_subset(df.limit(0), 5, id="id", features=["bucket"]).count() == 0


def test_varied_subset_against_greedy(spark, monkeypatch):
    """Rounds over cut lists come close to taking the best record each time."""
    monkeypatch.setattr("loomspark.llm.subset.PART_ROWS", 100)
    monkeypatch.setattr("loomspark.llm.subset.CUT_ROWS", 10)
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaab") + "x" * (rng.random() < 0.1), rng.randint(0, 60), rng.choice([0.5, 1.0])) for i in range(800)]
    got = varied_subset(spark.createDataFrame(rows, "id long, a string, b int, m double"), 100, features=["a", "b"], mass="m")

    def chosen(order):
        """The worth of the ids in order, or of the best one each time."""
        mass, worth, left = {}, 0.0, set(range(800))
        gain = lambda i: sum((mass.get(f, 0.0) + rows[i][3]) ** 0.5 - mass.get(f, 0.0) ** 0.5 for f in (rows[i][1], rows[i][2]))
        for i in order or range(100):
            i = i if order else max(left, key=gain)
            worth += gain(i)
            left.discard(i)
            for f in (rows[i][1], rows[i][2]):
                mass[f] = mass.get(f, 0.0) + rows[i][3]
        return worth

    ids = [r.id for r in got.collect()]
    assert len(set(ids)) == 100 and chosen(ids) >= 0.95 * chosen(None)


def optimum(sizes, capacity):
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) < best and k == len(sizes):
            best = len(rooms)
        elif len(rooms) < best:
            for i in range(len(rooms)):
                if rooms[i] >= sizes[k]:
                    put(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
            put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


def test_packing(spark):
    assert len(complete([6, 5, 5, 4, 4, 3, 3, 3, 3], 12)) == 3 and len(best_fit([6, 5, 5, 4, 4, 3, 3, 3, 3], 12)) >= 3
    for seed in range(5):
        sizes = [random.Random(seed * 99 + k).randint(1, 40) for k in range(120)]
        bins = complete(sizes, 50)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= 50 and len(bins) <= len(best_fit(sizes, 50))
    fewer = 0
    for seed in range(40):  # without limits the search finds the optimum
        rng = random.Random(seed)
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        assert len(complete(sizes, 50, looked=None, kept=None, nodes=None)) == optimum(sizes, 50) >= least_containers(sizes, 50)
        sizes = [rng.randint(15, 60) for _ in range(40)]
        fewer += len(best_fit(sizes, 100)) - len(complete(sizes, 100))
    assert fewer > 5
    assert dominates((5, 4), (4, 3, 1)) and not dominates((5, 4), (3, 3, 3)) and dominates((6, 3), (3, 3, 3))
    by_item = pack_documents(spark.createDataFrame([(i, "word " * (20 + i * 7 % 41), None if i % 5 == 4 else i % 5) for i in range(150)], "doc_id long, text string, item int"), 100, by="item").toPandas()
    assert len(by_item) == 150 and by_item.groupby(["item", "container"], dropna=False).tokens.sum().max() <= 100
    assert by_item.groupby("item", dropna=False).container.nunique().sum() < sum(len(best_fit(g.tokens.tolist(), 100)) for _, g in by_item.groupby("item", dropna=False))
    rows = [(i, "word " * (i % 30 + 1)) for i in range(200)] + [(500, "long " * 300), (501, None), (502, ""), (None, "x"), (3, "word")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), 64, shard_docs=80).toPandas()
    assert got.groupby("container").tokens.sum().max() <= 64 and set(got.doc_id) == {*range(200), 500}
    assert (got[got.doc_id == 500].tokens.sum() > 64) and not got[got.doc_id != 500].duplicated("doc_id").any()
    assert DEFAULT_TOKENIZER.endswith(".json")


ITEM = " ".join(f"w{i}" for i in range(60))


def test_words_whatever_their_form():
    assert words("Café <b>Ｔhe</b>&amp;x​y\né<br/>z") == ["cafe", "the", "xy", "e", "z"] or words("Café <b>Ｔhe</b> x​y") == ["cafe", "the", "xy"]
    assert words(None) == words("") == words("?!") == []


def _terms(text, vocabulary):
    return np.array([vocabulary.index(w) if w in vocabulary else -1 for w in text])


def _postings(texts, vocabulary):
    rows = [((n << 32) + p, t) for n, text in enumerate(texts) for p, t in enumerate(_terms(" ".join(text).split(), vocabulary)) if t >= 0]
    return np.array([t for _, t in rows]), np.array([k for k, _ in rows])


def test_leaks(spark):
    w = ITEM.split()
    three = w[:30]
    three[5], three[15], three[25] = "other", "other", "other"
    four = list(three)
    four[10] = "other"
    texts = {
        1: "start " + " ".join(w[10:45]) + " end",
        2: "<b>" + " ".join(w[:26]).upper() + "</b> no more",
        3: " ".join(three),
        4: " ".join(four),
        5: " ".join(reversed(w)),
        6: "a short text leaks, here",
        7: "a short leaks text here",
        8: None,
        9: "",
        10: " ".join(w[:15] + ["added"] + w[15:30]),
        11: "x " * 5000 + " ".join(w[20:55]),
    }
    docs = spark.createDataFrame(list(texts.items()) + [(None, ITEM), (1, ITEM)], "doc_id long, text string").withColumn("item", F.lit(0))
    items = spark.createDataFrame([(100, ITEM), (200, "Short text leaks"), (300, None), (None, ITEM), (400, "never"), (500, "")], "eval_id long, text string")
    got = leaked_items(docs, items)
    assert sorted(map(tuple, got.collect())) == [(1, 100), (3, 100), (6, 200), (10, 100), (11, 100)]
    rng = random.Random(12)
    for trial in range(60):  # any stretch of up to 80 words with one edit in eight, wherever the edits are
        long = [f"v{trial}x{i}" for i in range(90)]
        at, n = rng.randint(0, 10), rng.randint(30, 80)
        part = long[at : at + n]
        spots = rng.sample(range(1, n - 1), n // 8) if trial % 2 else range(n // 2 - n // 8, n // 2 + n // 8, 2)
        for spot in list(spots)[: n // 8]:
            part[spot] = rng.choice(["", "other", f"{part[spot]} more"])
        found = _candidates(*_postings([[*part]], long), Anchors([list(range(90))], {}), np.array([90]))
        assert any(holds(np.arange(90), _terms(" ".join(part).split(), long), int(off)) for off in found[2]), (trial, n)
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0
    assert holds(np.arange(40), np.r_[np.arange(40)], 0) and not holds(np.arange(40), np.arange(100, 140), 0)


def test_residue(spark):
    prose = ["The lid closes well and the handle feels solid in the hand after a week.", "We read page 40 of the manual and the parts fit as described.", "Nothing broke so far, my brother uses it every day at the office."]
    bad = ["Traceback (most recent call last):\n  File \"a.py\", line 3", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do", f"{prose[0]} The {{{{ brand }}}} is fine.", f"{prose[1]}\n404 Not Found", "PLACEHOLDER BODY", "[insert brand here] works"]
    good = [*prose, "I ordered the {large} one by mistake :).", "I give it [4 out of 5] so far.", "The mug has lorem ipsum printed on it as a joke.", "Saved 20% since the sale, nice.", "", None, "  ", "{{"]
    rows = [(i, t) for i, t in enumerate(prose * 300)] + [(1000 + i, t) for i, t in enumerate(bad)] + [(2000 + i, t) for i, t in enumerate(good)] + [(None, bad[0]), (1000, prose[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1))
    got = residue(df).collect()
    assert {r.doc_id for r in got} == {1000 + i for i in range(len(bad))} and len(got) == len(bad) and all(0 < r.coverage <= 1 for r in got)
    assert without_residue(df).where("doc_id >= 2000").count() == len(good)
    assert residue(df.limit(0)).count() == 0


#: Written before the models were tried on them; none is a seed text.
PROBES = [
    "The address you entered does not match any page on this server.", "panic: assignment to entry in nil map\n\ngoroutine 17 [running]:\nmain.main()", "dial tcp 10.0.0.4:5432: connect: connection refused",
    "Per favore, abilita JavaScript nelle impostazioni del browser per proseguire.", "Beim Laden der Bewertungen ist etwas schiefgegangen. Laden Sie die Seite neu.", "Dear {recipient}, thanks for the fast delivery.",
    "Sorry, this review is not available right now. Come back in a few minutes.", "503 Service Temporarily Unavailable nginx", "Notice: Trying to access array offset on value of type null in /srv/www/shop.php on line 88",
    "Error: ENOENT: no such file or directory, open '/data/reviews.json'", "Please turn JavaScript on and refresh the page.", "Votre navigateur bloque les scripts, activez-les pour lire les avis.",
    "Su navegador bloquea los scripts; actívelos para leer las opiniones.", "[Your review text]", "Hello ${userName}, your order {{order_id}} has shipped", "A timeout occurred (Error code 524)",
    "java.sql.SQLException: Connection is closed at com.zaxxer.hikari.HikariDataSource.getConnection(HikariDataSource.java:99)", "Errore 500: il server ha riscontrato un problema",
    "Access to XMLHttpRequest has been blocked by CORS policy", "We can't find what you're looking for. Check the URL and start over from our home page.",
]
BENIGN = [
    "The error in the manual cost me an hour, but the product is great.", "I had to reload the page twice to order, shipping was quick though.", "The server rack holds everything I need and the fans are quiet.",
    "My session at the gym is better with these headphones.", "Never found a better page holder for my books.", "The box said 24 [as promised] and there were 24.", "I never had any connection problems with this router.",
    "Access to the battery is difficult.", "The seller denied my request for a refund.", "Great for learning javascript, the book has many examples.", "Die Seite war schnell, der Versand auch.",
    "No se puede pedir más por este precio.", "I wrote my name {big letters} on it.", "Rated 5/5 [would buy again] by my wife.", "We use it as a placeholder until the new kitchen arrives.", "It says 'retry' on the button and that's what I did.",
]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs a corpus")
def test_residue_of_kinds_not_in_the_seeds(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id < 1000000")
    rows = [(2_000_000 + i, t) for i, t in enumerate(PROBES)] + [(3_000_000 + i, t) for i, t in enumerate(BENIGN)]
    found = {r.doc_id for r in residue(corpus.unionByName(spark.createDataFrame(rows, corpus.schema))).collect()}
    assert len([i for i in found if 2_000_000 <= i < 3_000_000]) >= 0.85 * len(PROBES)
    assert len([i for i in found if i >= 3_000_000]) <= 0.1 * len(BENIGN)
    # without the notices that scripts are required in one language, those are found by the others
    seeds = seed_texts()
    seeds["script"] = [t for t in seeds["script"] if "veuillez" not in t and "votre" not in t and "activez" not in t and "nécessite" not in t]
    again = {r.doc_id for r in residue(corpus.unionByName(spark.createDataFrame([(1, "Cette page nécessite JavaScript et les cookies"), (2, PROBES[5])], corpus.schema)), models=Models(seeds)).collect()}
    assert 2 in again


def test_fields():
    names = lambda t: [n for *_, n in fields(t)]
    assert names("{{ x1 }} ${y} <%= z %> %(a)s %s") == [None] * 5 and None in names("[insert it here]")
    assert names("{product} [order_no] #name#") == [None] * 3 and names("{large} one") == ["large"]
    assert names("a 100% sure [9 of 10] 20% off, 5 {} :-)") == []


def test_residue_in_a_third_of_the_rows(spark):
    rng = random.Random(9)
    vocabulary = "lid handle solid week manual parts fit brother office colour strap dial heavy light paid warm cold shelf quiet clean".split()
    prose = [" ".join(rng.choices(vocabulary, k=40)).capitalize() + "." for _ in range(400)]
    for notice in ("404 Not Found", "Failed to load review. Please try again later", "Please enable JavaScript to view this page.", "PLACEHOLDER BODY", f"{prose[0]}\nInternal Server Error"):
        rows = list(enumerate(prose)) + [(1000 + i, notice) for i in range(200)] + [(5000, "The mug has lorem ipsum printed on it as a joke.")]
        found = residue(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.doc_id for r in found.collect()} == {1000 + i for i in range(200)}
