"""Choosing a varied subset by concave feature coverage.

A subset is worth the sum, over features, of the square root of the mass it has selected in each, so every further record of a bucket
(or a near-equal one) adds less than the one before. Selection runs in rounds of descending threshold, and all that a round needs is
tables: the records that may still reach the threshold, and the masses selected so far.

A round lists, for each feature, the records that have it in a random but fixed order. A record's sure gain is what it adds if all
records before it, in every one of its features, were chosen too; records whose sure gain reaches the threshold are added, so what is
added has a marginal gain of at least the threshold whatever else the round adds. The others are left with the gain they had as a bound:
gains only fall, and a record isn't looked at again until the threshold is down to its bound. The next threshold is STEP times this one,
or lower if no bound reaches that.

A feature's list is cut into parts by the order, whose masses are added up first, so a feature of a third of all rows is no single
task's. Masses and gains are whole numbers of small units, so sums, and with them the subset, are the same on each run.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import Workspace

#: Factor from one round's threshold to the next; gains below LAST are as good as none, and records are then taken in order.
STEP, LAST = 0.8, 1e-3
#: Units of a mass and of a gain.
MASS, GAIN = 2**20, 2**40
#: Records of one part of a feature's list, about.
PART_ROWS = 50_000
#: Records left when the place of a cut is looked up among them.
CUT_ROWS = 4_096
FEATURES = ("f0", "f1", "f2")
_LONG = "stack(3, 0, f0, 1, f1, 2, f2) AS (k, f)"


def _order(seed: int) -> str:
    return f"xxhash64('{seed}', id)"


def _evaluated(near: DataFrame, masses: DataFrame, seed: int, bits: int) -> DataFrame:
    """(id, f0, f1, f2, m, bound, sure) of the records ``near``: bound is what each adds to ``masses``, sure what it adds after all before it."""
    part = f"shiftright({_order(seed)}, {64 - bits})" if bits else "0L"
    long = near.selectExpr("id", "m", f"{_order(seed)} AS r", f"{part} AS part", _LONG).where("f IS NOT NULL")
    earlier = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = long.groupBy("f", "part").agg(F.sum("m").alias("t")).join(masses, "f", "left")
    base = totals.select("f", "part", F.coalesce("mass", F.lit(0)).alias("mass"), (F.coalesce("mass", F.lit(0)) + F.coalesce(F.sum("t").over(earlier), F.lit(0))).alias("base"))
    within = Window.partitionBy("f", "part").orderBy("r", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = long.join(base, ["f", "part"]).withColumn("base", F.col("base") + F.coalesce(F.sum("m").over(within), F.lit(0)))
    gain = "CAST(round((sqrt(({0} + m) / {1}D) - sqrt({0} / {1}D)) * {2}D) AS BIGINT) AS {3}"
    each = placed.selectExpr("id", "m", "k", "f", gain.format("mass", MASS, GAIN, "now"), gain.format("base", MASS, GAIN, "sure"))
    own = [F.max(F.when(F.col("k") == k, F.col("f"))).alias(f) for k, f in enumerate(FEATURES)]
    return each.groupBy("id").agg(*own, F.max("m").alias("m"), F.sum("now").alias("bound"), F.sum("sure").alias("sure"))


def _first(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows of ``rows`` (id, ...) that come first in the order, all if there are no more: the digits of the cut are counted out one by one."""
    placed = rows.withColumn("__r", F.expr(_order(seed)))
    left, digits, inside = n, 0, F.lit(True)
    below = F.lit(False)
    while True:
        shift = 64 - 10 * (digits + 1)
        if shift < 0:
            break
        digit = F.shiftright("__r", shift)
        counts = sorted((d, c) for d, c in placed.where(inside).groupBy(digit.alias("d")).count().collect())  # at most 1024 rows
        if sum(c for _, c in counts) <= left:
            return placed.where(below | inside).drop("__r")
        for d, c in counts:
            if c > left:
                break
            left -= c
        below = below | (inside & (digit < d))
        inside, digits = inside & (digit == d), digits + 1
        if c <= CUT_ROWS:
            break
    last = sorted(tuple(x) for x in placed.where(inside).select("__r", "id").collect())[:left]  # at most CUT_ROWS rows, unless ids share 60 bits of their hash
    if not last:
        return placed.where(below).drop("__r")
    r, i = last[-1]
    return placed.where(below | (inside & ((F.col("__r") < r) | ((F.col("__r") == r) & (F.col("id") <= i))))).drop("__r")


def varied_subset(
    records: DataFrame,
    k: int | None = None,
    *,
    share: float | None = None,
    id: str = "id",
    features: list[str],
    mass: str | None = None,
    seed: int = 7,
    log: list[dict] | None = None,
) -> DataFrame:
    """k records, or a ``share`` of them (all, if there are no more), that cover the features' values broadly: columns id, turn and gain.

    ``features`` names up to three columns of any type; records with an equal value share that feature, and a null is no feature.
    ``mass`` (default 1) is what a record adds to its features: null, NaN, infinite and values up to 0 count as 1. Null ids are left
    out, and an id that occurs several times counts once. turn is the round that added the record and gain the least it added; records
    taken when no gain was left have a gain of 0. Ties are broken by a hash of the id, so the result is the same on each run. ``log``
    receives the threshold, the records looked at and those added of every round.
    """
    if (k is None) == (share is None) or (k or 0) < 0 or not 0 <= (share or 0) <= 1 or not 1 <= len(features) <= len(FEATURES):
        raise ValueError("k of 0 or more or a share from 0 to 1, and 1 to 3 features must be given")
    ws = Workspace(records.sparkSession)
    cols = [F.when(F.col(f"`{f}`").isNotNull(), F.xxhash64(F.lit(n), F.col(f"`{f}`"))).alias(n) for n, f in zip(FEATURES, features)]
    cols += [F.lit(None).cast("long").alias(n) for n in FEATURES[len(features) :]]
    w = F.col(f"`{mass}`").cast("double") if mass else F.lit(1.0)
    fine = w.isNotNull() & (w > 0) & ~F.isnan(w) & (w < 2.0**40)
    units = F.greatest(F.lit(1), F.round(F.when(fine, w).otherwise(1.0) * MASS).cast("long"))
    rows = records.select(F.col(f"`{id}`").cast("long").alias("id"), *cols, units.alias("m")).where("id IS NOT NULL")
    once = rows.groupBy("id").agg(F.min(F.struct(*FEATURES, "m")).alias("r")).select("id", "r.*")
    start = "CAST(ceil(sqrt(m / {}D) * {}D) AS BIGINT)".format(MASS, GAIN)
    first = once.withColumn("bound", F.expr(" + ".join(f"CASE WHEN {f} IS NULL THEN 0L ELSE {start} + 1 END" for f in FEATURES))).withColumn("sure", F.lit(0).cast("long"))
    first = ws.keep(first, "records")
    n, most = first.agg(F.count("*"), F.max("bound")).first()
    room = min(n, round(share * n) if k is None else k)
    bits = max(0, math.ceil(math.log2(max(1, n / PART_ROWS))))
    masses = records.sparkSession.createDataFrame([], "f long, mass long")
    frames: list[tuple[DataFrame, int | None]] = [(first, None)]  # (records as evaluated, the threshold at which some of them were added)
    picked: list[DataFrame] = []
    threshold, before = int((most or 0) * STEP), None

    def left() -> DataFrame:
        """The records not added. Those with a bound from the last threshold up, but for those of the last round, have been evaluated again."""
        out = []
        for frame, at in frames:
            rows = frame if at is None else frame.where(F.col("sure") < at)
            out.append(rows if before is None or frame is frames[-1][0] else rows.where(F.col("bound") < before))
        return reduce(DataFrame.unionByName, out)

    while room > 0 and threshold >= LAST * GAIN:
        turn = ws.keep(_evaluated(left().where(F.col("bound") >= threshold), masses, seed, bits), "turn")
        looked, added = turn.agg(F.count("*"), F.count_if(F.col("sure") >= threshold)).first()
        if log is not None:
            log.append({"threshold": threshold / GAIN, "looked": looked, "added": min(added, room)})
        taken = turn.where(F.col("sure") >= threshold)
        if added > room:
            taken = _first(taken, room, seed)
        picked.append(taken.select("id", F.lit(len(picked) + 1).alias("turn"), (F.col("sure") / float(GAIN)).alias("gain")))
        room -= min(added, room)
        frames.append((turn, threshold))
        before = threshold
        if room:
            more = taken.selectExpr("m", _LONG).where("f IS NOT NULL").selectExpr("f", "m AS mass")
            newer = ws.keep(masses.unionByName(more).groupBy("f").agg(F.sum("mass").alias("mass")), "masses")
            ws.drop(masses)
            masses = newer
            threshold = min(int(threshold * STEP), left().agg(F.max("bound")).first()[0] or 0)
        ws.sweep()
    if room > 0:
        rest = _first(left().select("id"), room, seed)
        picked.append(rest.select("id", F.lit(len(picked) + 1).alias("turn"), F.lit(0.0).alias("gain")))
    if not picked:
        picked.append(first.limit(0).select("id", F.lit(1).alias("turn"), F.lit(0.0).alias("gain")))
    return reduce(DataFrame.unionByName, picked).withColumnRenamed("id", id)
