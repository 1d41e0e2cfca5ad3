from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from loomspark.graph import GraphFrame, triangles


def expected(pairs):
    near = {}
    for a, b in pairs:
        if a != b and None not in (a, b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    n = Counter()
    for a, x in near.items():
        for b in x:
            n[a] += len(x & near[b])
    return {a: k // 2 for a, k in n.items()}


def counted(spark, pairs, kind="long"):
    ids = sorted({x for p in pairs for x in p if x is not None})
    v = spark.createDataFrame([(x,) for x in ids], f"id {kind}")
    got = GraphFrame(v, spark.createDataFrame(pairs, f"src {kind}, dst {kind}")).triangleCount()
    assert dict(got.dtypes) == {"id": v.dtypes[0][1], "count": "bigint"}
    out = {r["id"]: r["count"] for r in got.collect()}
    assert out == {x: expected(pairs).get(x, 0) for x in ids}
    return out


def shuffled(spark):
    """Records that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_pairs_of_edges_are_not_shuffled(spark):
    pairs = list(combinations(range(150), 2))
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for edges that are too many to broadcast
    try:
        assert set(counted(spark, pairs).values()) == {149 * 148 // 2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    records = sum(n for at, n in shuffled(spark).items() if at not in before)
    assert records < 4 * len(pairs)  # 551,300 pairs of edges meet, of 11,175


# BLOCK 40: partitions in pieces; BATCH 7: lists over several batches; LOOKED 5: lists longer than what is looked up at once.
@pytest.mark.parametrize("block, batch, looked", [(triangles.BLOCK, triangles.BATCH, triangles.LOOKED), (40, 7, 5), (300, 50, 20)])
def test_blocks_batches_and_hubs(spark, monkeypatch, block, batch, looked):
    for name, value in {"BLOCK": block, "BATCH": batch, "LOOKED": looked, "ROWS": 10}.items():
        monkeypatch.setattr(triangles, name, value)
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-30, 30, (500, 2))]
    hubs = [(h, k) for h in (-40, 0, 70) for k in range(-30, 60)]  # one below, one among and one above its neighbours
    counted(spark, pairs + hubs + hubs[:50] + [(b, a) for a, b in hubs[:50]] + [(None, 1), (2, None), (7, 7)])


def test_other_ids_and_no_triangles(spark):
    assert counted(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("", "a")], "string")["d"] == 0
    assert counted(spark, [(1, 2), (2, 3), (3, 1)], "int") == {1: 1, 2: 1, 3: 1}
    assert counted(spark, [(4, 4)]) == {4: 0}
    big = 2**62
    assert set(counted(spark, [(-big, big), (big, 0), (0, -big), (big, big)]).values()) == {1}
