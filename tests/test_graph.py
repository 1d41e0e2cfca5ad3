import pytest
from pyspark.sql import functions as F

from loomspark.graph import AggregateMessages as AM
from loomspark.graph import GraphFrame, Pregel
from loomspark.graph.examples import belief_propagation, friends, grid_ising_model


# The small graphs of these tests and what comes out of them.
@pytest.fixture(scope="module")
def g(spark):
    v = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, name string")
    e = spark.createDataFrame([(1, 2, "love"), (2, 1, "hate"), (2, 3, "follow")], "src long, dst long, action string")
    return GraphFrame(v, e)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ids(spark, n):
    return spark.range(n).select("id")


def test_columns_are_checked(spark, g):
    with pytest.raises(ValueError):
        GraphFrame(g.edges, g.edges)
    with pytest.raises(ValueError):
        GraphFrame(g.vertices, g.vertices)


def test_motifs_filters_and_paths(g):
    assert g.find("(a)-[e]->(b)").count() == 3
    assert g.find("(a)-[]->(b); (b)-[]->(a)").count() == 2
    assert [(r.a.id, r.c.id) for r in g.find("(a)-[]->(b); (b)-[]->(c); !(a)-[]->(c)").collect() if r.a.id != r.c.id] == [(1, 3)]
    two = g.filterVertices("id < 3")
    assert two.vertices.count() == 2 and two.edges.count() == 2
    far = g.filterEdges(F.col("dst") > 2)
    assert far.vertices.count() == 3 and far.edges.count() == 1
    assert {r.name for r in far.dropIsolatedVertices().vertices.collect()} == {"B", "C"}
    with pytest.raises(TypeError):
        g.filterVertices(3)
    path = g.bfs("name = 'A'", "name = 'C'")
    assert path.columns == ["from", "e0", "v1", "e1", "to"] and [r.v1.name for r in path.collect()] == ["B"]
    assert g.bfs("name = 'A'", "name = 'C'", edgeFilter="action <> 'follow'").count() == 0
    assert g.bfs("name = 'A'", "name = 'C'", maxPathLength=1).count() == 0


def test_degrees_and_triplets(g):
    assert {r.id: r.degree for r in g.degrees.collect()} == {1: 2, 2: 3, 3: 1}
    assert {r.id: r.inDegree for r in g.inDegrees.collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.id: r.outDegree for r in g.outDegrees.collect()} == {1: 1, 2: 2}
    assert g.triplets.columns == ["src", "edge", "dst"] and g.triplets.count() == 3


@pytest.mark.parametrize("sql", [False, True])
def test_messages(spark, sql):
    people = friends(spark)
    if sql:
        got = people.aggregateMessages("sum(MSG) AS total", sendToSrc="CASE WHEN edge.relationship = 'friend' THEN dst.age + 1 ELSE dst.age END", sendToDst="src.age")
    else:
        got = people.aggregateMessages(F.sum(AM.msg).alias("total"), sendToSrc=F.when(AM.edge["relationship"] == "friend", AM.dst["age"] + 1).otherwise(AM.dst["age"]), sendToDst=AM.src["age"])
    assert {r.id: r.total for r in got.collect()} == {"a": 66, "b": 94, "c": 108, "d": 67, "e": 66, "f": 62}
    with pytest.raises(ValueError):
        people.aggregateMessages(F.sum(AM.msg))
    with pytest.raises(TypeError):
        people.aggregateMessages(F.sum(AM.msg), sendToSrc=3)
    assert {r.component for r in people.connectedComponents().collect()} == {"a"}


def test_pregel_pagerank(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 4), (2, 0), (3, 4), (4, 0), (4, 2)])
    v = GraphFrame(ids(spark, 5), e).outDegrees
    p = GraphFrame(v, e).pregel.setMaxIter(5).withVertexColumn("rank", F.lit(1.0 / 5), F.coalesce(Pregel.msg(), F.lit(0.0)) * 0.85 + 0.15 / 5)
    rank = p.sendMsgToDst(Pregel.src("rank") / Pregel.src("outDegree")).aggMsgs(F.sum(Pregel.msg())).run()
    got = [r["rank"] for r in rank.orderBy("id").collect()]
    assert got == pytest.approx([0.245, 0.224, 0.303, 0.03, 0.197], abs=1e-3)


def test_components(spark):
    assert GraphFrame(ids(spark, 7), edges(spark, [(5, 4), (4, 3), (0, 1), (6, 6)])).connectedComponents().select("id", "component").orderBy("id").collect() == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 3), (6, 6)]
    islands = GraphFrame(ids(spark, 5), edges(spark, [(7, 8)])).stronglyConnectedComponents(5)
    assert all(r.id == r.component for r in islands.collect()) and islands.count() == 5
    loop = GraphFrame(ids(spark, 5), edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)])).stronglyConnectedComponents(10)
    assert sorted((r.id, r.component) for r in loop.collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)]


def test_labels_triangles_and_paths(spark):
    blob = [(a, b) for s in (0, 5) for a in range(s, s + 5) for b in range(s, s + 5) if a < b]
    g = GraphFrame(ids(spark, 10), edges(spark, [*blob, (0, 5)]))
    label = {r.id: r.label for r in g.labelPropagation(20).collect()}
    assert len({label[i] for i in range(5)}) == 1 and len({label[i] for i in range(5, 10)}) == 1 and label[0] != label[9]
    assert {r["count"] for r in g.triangleCount().collect()} == {6}
    both = [(1, 2), (1, 5), (2, 3), (2, 5), (3, 4), (4, 5), (4, 6)]
    e = edges(spark, both + [(b, a) for a, b in both])
    d = GraphFrame(spark.range(1, 7).select("id"), e).shortestPaths([1, 4])
    assert {r.id: r.distances for r in d.collect()} == {1: {1: 0, 4: 2}, 2: {1: 1, 4: 2}, 3: {1: 2, 4: 1}, 4: {1: 2, 4: 0}, 5: {1: 1, 4: 1}, 6: {1: 3, 4: 1}}


def test_ranks(spark):
    star = GraphFrame(ids(spark, 11), edges(spark, [(i, 0) for i in range(1, 11)]))
    r = star.pageRank(tol=0.01)
    assert "weight" in r.edges.columns and r.vertices.orderBy(F.desc("pagerank")).first().id == 0
    p = star.parallelPersonalizedPageRank(sourceIds=[1, 2], maxIter=2).vertices
    assert {x.id: x.pageranks for x in p.collect()}[3] == [0.0, 0.0]
    with pytest.raises(AssertionError):
        star.pageRank()


def test_factors_and_beliefs(spark):
    v, loss = GraphFrame(ids(spark, 4), edges(spark, [(0, 2), (0, 3), (1, 2)]).withColumn("weight", F.lit(3.0))).svdPlusPlus(rank=2)
    assert v.columns == ["id", "column1", "column2", "column3", "column4"] and loss >= 0
    with pytest.raises(ValueError):
        grid_ising_model(spark, 0)
    b = belief_propagation(grid_ising_model(spark, 3), 2).collect()
    assert len(b) == 9 and all(0 <= r.belief <= 1 for r in b)
