import random

import pytest

from loomspark.operators.hierarchy import descendants, hierarchy, paths


def brute(links):
    parent = {}
    for i, p in links:
        if i is not None:
            parent.setdefault(i, []).append(p)
    parent = {i: min((p for p in ps if p and p in parent), default=None) for i, ps in parent.items()}
    out = {}
    for i in parent:
        path, x = [], i
        while x is not None and x not in path:
            path.append(x)
            x = parent[x]
        out[i] = (path[-1], path[::-1]) if x is None else (min(path[path.index(x) :]), None)
    return out


def random_forest(n, seed):
    rng = random.Random(seed)
    links = [(i, rng.choice([None, 0, rng.randint(1, max(1, i - 1)), i - 1, i - 1, 10**6])) for i in range(1, n + 1)]
    links += [(n + 1, n + 3), (n + 2, n + 1), (n + 3, n + 2), (n + 4, n + 1), (n + 5, n + 5), (n + 6, n + 4)]
    links += [links[3], (None, 3), (None, None)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("range_nodes", [1000, 50])
def test_against_brute_force(spark, range_nodes):
    links = random_forest(120, range_nodes)
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in links], "id long, parent long, size string, path int")
    tree = hierarchy(df, range_nodes=range_nodes).cache()
    rows = {r.id: r for r in tree.collect()}
    want = brute(links)
    assert rows.keys() == want.keys() and tree.count() == len(want)
    below = {i: 0 for i in want}
    for i, (root, path) in want.items():
        assert rows[i].root_id == root and rows[i].cyclic == (path is None)
        assert rows[i].depth == (None if path is None else len(path) - 1)
        for a in path or []:
            below[a] += 1
            assert rows[a].pre <= rows[i].pre <= rows[a].last
    assert all(rows[i].size == below[i] for i, (_, path) in want.items() if path)
    assert {r.id: r.path for r in paths(tree, unit_nodes=7).collect()} == {i: path for i, (_, path) in want.items() if path}
    assert descendants(tree).count() == sum(len(path) - 1 for _, path in want.values() if path)


def test_long_chain_in_ranges_and_long_cycle(spark):
    chain = [(i, i - 1) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1099)] + [(1099, 1000)]
    rows = {r.id: r for r in hierarchy(spark.createDataFrame(chain, "id long, parent long"), range_nodes=60).collect()}
    assert rows[199].root_id == 1 and rows[199].depth == 198 and rows[1].size == 199
    assert {rows[i].root_id for i in range(1000, 1100)} == {1000}


@pytest.mark.parametrize("range_nodes", [1000, 5])
def test_paths_and_descendants_of_loops(spark, range_nodes):
    links = random_forest(25, 3) + [(60 + i, 60 + (i + 1) % 7) for i in range(7)] + [(70, 63), (71, 70), (72, 70), (73, 61), (74, 73)]
    tree = hierarchy(spark.createDataFrame(links, "id long, parent long"), range_nodes=range_nodes).cache()
    parent = {r.id: r.parent for r in tree.collect()}
    want_paths, want = {}, set()
    for i in parent:
        walk, x = [], i
        while x is not None and x not in walk:
            walk.append(x)
            x = parent[x]
        stop = next(k for k, y in enumerate(walk) if x is None and parent[y] is None or x is not None and y in walk[walk.index(x) :])
        want_paths[i] = walk[stop::-1]
        want |= {(a, i, k) for k, a in enumerate(walk) if k}
    assert {r.id: r.path for r in paths(tree, unit_nodes=3, loops=True).collect()} == want_paths
    got = [tuple(r) for r in descendants(tree, loops=True).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {r.id: r["size"] for r in tree.collect()} == {i: 1 + sum(a == i for a, _, _ in want) for i in parent}


def test_shuffled_chain_needs_few_rounds(spark):
    """A chain whose ids don't follow it, a caterpillar, and a cycle with a long tail: rounds grow with the logarithm of the nodes."""
    n = 30_000
    place = lambda k: (k * 7919 + 13) % 100_003 + 1
    chain = [(place(k), place(k - 1) if k else None) for k in range(n)]
    legs = [(200_000 + k, place(k)) for k in range(0, n, 100)]
    ring = [(300_000 + k, 300_000 + (k * 17 + 17) % 51) for k in range(51)] + [(400_000 + k * 31 % 997, 400_000 + (k - 1) * 31 % 997 if k else 300_000) for k in range(900)]
    log = []
    rows = {r.id: r for r in hierarchy(spark.createDataFrame(chain + legs + ring, "id long, parent long"), range_nodes=300, log=log).collect()}
    assert len(log) < 20 and len(rows) == n + len(legs) + 51 + 900
    assert all(rows[place(k)].depth == k and rows[place(k)].root_id == place(0) for k in range(0, n, 997))
    assert rows[place(0)]["size"] == n + len(legs) and rows[place(n - 1)]["size"] == 1 and rows[200_000].depth == 1
    assert {r.pre for r in rows.values() if r.root_id == place(0)} == set(range(n + len(legs)))
    assert all(rows[i].cyclic for i in (300_000, 300_050, 400_000)) and rows[400_000].loop_id == 300_000


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "id long, parent long")).count() == 0
