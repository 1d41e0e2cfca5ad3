"""Iterative graph algorithms: a driver loop of joins and aggregates, the lineage cut in every round by a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.graph.triangles import triangles_of
from loomspark.session import Workspace, shared_dir


def _cut(df: DataFrame) -> DataFrame:
    return Workspace(df.sparkSession).keep(df)


def _drop(df: DataFrame) -> None:
    Workspace(df.sparkSession).drop(df)


def components_of(links: DataFrame, log: list[int] | None = None) -> DataFrame:
    """(id, component) for the ids of ``links`` (a, b), by alternating large-star and small-star steps until only stars are left. ``log``
    receives the number of links at the start of every round."""
    ws = Workspace(links.sparkSession)
    e = ws.keep(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # stars: every end has one link to a smaller one, which has none itself
        n, ends = e.agg(F.count("*"), F.count_distinct("a")).first()
        if log is not None:
            log.append(n)
        if n == ends and e.join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).distinct()
        newer = ws.keep(small, "links")
        ws.drop(e)
        e = newer
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def connected_components(g) -> DataFrame:
    found = components_of(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.vertices.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def strongly_connected_components(g, max_iter: int) -> DataFrame:
    """Vertices with ``component``, the least id of those that reach each other. Each round finds, for every colour (the least id that
    reaches a vertex), the part of it that reaches that id back; vertices left after ``max_iter`` rounds are their own component."""
    shared_dir(g.vertices.sparkSession)
    ids = g.vertices.select("id").distinct()
    edges = g.edges.select("src", "dst").where("src <> dst").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    left, edges, done = _cut(ids), _cut(edges), None
    for _ in range(max_iter):
        if left.isEmpty():
            break
        colour = _spread(left.select("id", F.col("id").alias("c")), edges)
        inside = edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        inside = _cut(inside)
        back = colour.where("id = c").select("id", F.col("c").alias("component"))
        front = back
        while not front.isEmpty():
            step = inside.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "component").distinct()
            front = _cut(step.join(back, "id", "left_anti"))
            back = _cut(back.unionByName(front))
        done = back if done is None else _cut(done.unionByName(back))
        left = _cut(left.join(back, "id", "left_anti"))
        edges = _cut(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    if done is None:
        return g.vertices.withColumn("component", F.col("id"))
    return g.vertices.join(done, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _spread(value: DataFrame, edges: DataFrame) -> DataFrame:
    """The least ``c`` among all vertices from which each one is reached."""
    value = written = _cut(value)
    while True:
        sent = edges.join(value.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        newer = _cut(value.join(sent, "id", "left").select("id", F.least("c", "m").alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("moved")))
        _drop(written)
        value, written = newer.select("id", "c"), newer
        if newer.where("moved").isEmpty():
            return value


def label_propagation(g, max_iter: int) -> DataFrame:
    """Vertices with ``label``: in every round all take the label most frequent among their neighbours, of several the least."""
    shared_dir(g.vertices.sparkSession)
    both = _cut(g.edges.select("src", "dst").unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    label = g.vertices.select("id", F.col("id").alias("label"))
    for _ in range(max_iter):
        votes = both.join(label.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        won = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("won"))
        newer = _cut(label.join(won, "id", "left").select("id", F.coalesce("won", "label").alias("label")))
        _drop(label)
        label = newer
    return g.vertices.join(label, "id")


def page_rank(g, reset: float, source, max_iter: int | None, tol: float | None):
    """A graph whose vertices have ``pagerank`` and whose edges have ``weight`` (one over the source's out-degree). Ranks start at 1 and
    aren't normalised; with a source, it alone starts at 1 and takes all of the reset."""
    from loomspark.graph.frame import GraphFrame

    shared_dir(g.vertices.sparkSession)
    weighted = g.edges.join(g.outDegrees.withColumnRenamed("id", "src"), "src").withColumn("weight", 1.0 / F.col("outDegree")).drop("outDegree").select(*g.edges.columns, "weight")
    links = _cut(weighted.select("src", "dst", "weight"))
    base = F.lit(1.0) if source is None else (F.col("id") == F.lit(source)).cast("double")
    rank = written = _cut(g.vertices.select("id", base.alias("pagerank")))
    step = 0
    while max_iter is None or step < max_iter:
        sent = links.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") * F.col("weight")).alias("m"))
        newer = rank.join(sent, "id", "left").select("id", F.col("pagerank").alias("old"), (reset * base + (1.0 - reset) * F.coalesce("m", F.lit(0.0))).alias("pagerank"))
        newer = _cut(newer)
        _drop(written)
        rank, written, step = newer.select("id", "pagerank"), newer, step + 1
        if tol is not None and (newer.agg(F.max(F.abs(F.col("pagerank") - F.col("old")))).first()[0] or 0.0) <= tol:
            break
    return GraphFrame(g.vertices.join(rank, "id"), weighted)


def personalized_page_ranks(g, reset: float, sources: list, max_iter: int):
    """A graph whose vertices have ``pageranks``, one value for each source in the order given."""
    from loomspark.graph.frame import GraphFrame

    spark = g.vertices.sparkSession
    shared_dir(spark)
    weighted = g.edges.join(g.outDegrees.withColumnRenamed("id", "src"), "src").withColumn("weight", 1.0 / F.col("outDegree")).drop("outDegree").select(*g.edges.columns, "weight")
    links = _cut(weighted.select("src", "dst", "weight"))
    kind = g.vertices.schema["id"].dataType.simpleString()
    at = spark.createDataFrame([(s, k) for k, s in enumerate(sources)], f"id {kind}, k int")
    base = g.vertices.select("id").join(F.broadcast(at), "id").select("id", "k", F.lit(1.0).alias("r"))
    rank = _cut(base)
    for _ in range(max_iter):
        sent = links.join(rank.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "k", ((1.0 - reset) * F.col("r") * F.col("weight")).alias("r"))
        rank = _cut(sent.unionByName(base.withColumn("r", F.lit(reset))).groupBy("id", "k").agg(F.sum("r").alias("r")))
    packed = rank.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("m"))
    values = F.array(*(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0)) for k in range(len(sources))))
    return GraphFrame(g.vertices.join(packed, "id", "left").withColumn("pageranks", values).drop("m"), weighted)


def shortest_paths(g, landmarks: list) -> DataFrame:
    """Vertices with ``distances``: a map from each landmark that can be reached to the number of edges there."""
    spark = g.vertices.sparkSession
    shared_dir(spark)
    kind = g.vertices.schema["id"].dataType.simpleString()
    marks = spark.createDataFrame([(x,) for x in dict.fromkeys(landmarks)], f"id {kind}")
    known = _cut(g.vertices.select("id").join(F.broadcast(marks), "id", "left_semi").distinct().select("id", F.col("id").alias("landmark"), F.lit(0).alias("d")))
    edges, front = g.edges.select("src", "dst").distinct(), known
    step = 0
    while not front.isEmpty():
        step += 1
        reached = edges.join(front.select(F.col("id").alias("dst"), "landmark"), "dst").select(F.col("src").alias("id"), "landmark").distinct()
        front = _cut(reached.join(known, ["id", "landmark"], "left_anti").withColumn("d", F.lit(step)))
        known = _cut(known.unionByName(front))
    packed = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("landmark", "d"))).alias("distances"))
    return g.vertices.join(packed, "id", "left").withColumn("distances", F.coalesce("distances", F.create_map().cast(f"map<{kind},int>")))


def triangle_count(g) -> DataFrame:
    """Vertices with ``count``, the triangles they are in; direction, repeated edges and loops don't matter."""
    e = g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return g.vertices.join(triangles_of(e), "id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def svd_plus_plus(g, rank: int, max_iter: int, low: float, high: float, gamma1: float, gamma2: float, gamma6: float, gamma7: float) -> tuple[DataFrame, float]:
    """Rating prediction over edges with ``weight``: (vertices with column1..column4, loss).

    column1: the factors; column2: the implicit factors; column3: the bias; column4: one over the root of the degree. A round computes
    every edge's error from the last round's values and then moves all vertices at once (a batch gradient step), so rounds are joins
    and aggregates; the loss is the sum of squared errors of the last round.
    """
    shared_dir(g.vertices.sparkSession)
    e = g.edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    mean = e.agg(F.avg("w")).first()[0] or 0.0
    deg = g.degrees

    def start(salt: int):
        return F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda k: (F.pmod(F.xxhash64(F.col("id").cast("string"), k, F.lit(salt)), F.lit(1000)) / 1000.0 - 0.5) * 0.1)

    v = g.vertices.select("id").join(deg, "id", "left").select("id", start(1).alias("p"), start(2).alias("q"), F.lit(0.0).alias("b"), (1.0 / F.sqrt(F.greatest(F.coalesce("degree", F.lit(1)), F.lit(1)))).alias("n"))
    v, loss = _cut(v), 0.0
    add = lambda x, y: F.zip_with(x, y, lambda i, j: i + j)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    for _ in range(max_iter):
        item = v.select(F.col("id").alias("dst"), F.col("p").alias("ip"), F.col("q").alias("iq"), F.col("b").alias("ib"))
        user = v.select(F.col("id").alias("src"), F.col("p").alias("up"), F.col("b").alias("ub"), F.col("n").alias("un"))
        implicit = e.join(item, "dst").groupBy("src").agg(F.array(*(F.sum(F.get("iq", F.lit(k))) for k in range(rank))).alias("y"))
        t = e.join(item, "dst").join(user, "src").join(implicit, "src")
        full = add("up", F.transform("y", lambda x: x * F.col("un")))
        guess = F.least(F.greatest(F.lit(mean) + F.col("ub") + F.col("ib") + dot("ip", full), F.lit(low)), F.lit(high))
        t = _cut(t.withColumn("full", full).withColumn("err", F.col("w") - guess))
        loss = t.agg(F.sum(F.col("err") * F.col("err"))).first()[0] or 0.0
        grad = lambda a, b: F.zip_with(a, b, lambda x, y: gamma2 * (F.col("err") * x - gamma7 * y))
        bias = lambda b: gamma1 * (F.col("err") - gamma6 * F.col(b))
        zero = F.array_repeat(F.lit(0.0), rank)
        moves = t.select(F.col("src").alias("id"), grad("ip", "up").alias("dp"), zero.alias("dq"), bias("ub").alias("db")).unionByName(
            t.select(F.col("dst").alias("id"), grad("full", "ip").alias("dp"), F.zip_with("ip", "iq", lambda x, y: gamma2 * (F.col("err") * F.col("un") * x - gamma7 * y)).alias("dq"), bias("ib").alias("db"))
        )
        total = moves.groupBy("id").agg(*(F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(rank))).alias(c) for c in ("dp", "dq")), F.sum("db").alias("db"))
        v = _cut(v.join(total, "id", "left").select("id", F.coalesce(add("p", "dp"), "p").alias("p"), F.coalesce(add("q", "dq"), "q").alias("q"), (F.col("b") + F.coalesce("db", F.lit(0.0))).alias("b"), "n"))
    named = v.select("id", F.col("p").alias("column1"), F.col("q").alias("column2"), F.col("b").alias("column3"), F.col("n").alias("column4"))
    return g.vertices.join(named, "id"), float(loss)
