"""Linear referencing: ordered points as segments, running length and samples along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, seg (from 0), x1, y1, x2, y2, from (running length at the start) and to, of consecutive points."""
    w = Window.partitionBy(key).orderBy(*order)
    ends = points.select(key, (F.row_number().over(w) - 1).alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    run = Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return ends.withColumn("to", F.sum(size).over(run)).withColumn("from", F.col("to") - size)


def samples(segs: DataFrame, key: str, step: float) -> DataFrame:
    """Points at 0, step, 2 step, ... along each line and at its end: key, sample, at, x, y and the unit direction tx, ty."""
    inside = F.expr(f"case when `from` < `to` then sequence(cast(ceil(`from` / {step}D) as bigint), cast(ceil(`to` / {step}D) as bigint)) else array() end")
    flat = segs.withColumn("sample", F.explode(inside)).where(f"sample * {step}D >= `from` and sample * {step}D < `to`").withColumn("at", F.expr(f"sample * {step}D"))
    last = segs.groupBy(key).agg(F.max_by(F.struct(*segs.columns), F.col("seg")).alias("s")).select("s.*").withColumn("sample", F.expr(f"cast(ceil(`to` / {step}D) as bigint)")).withColumn("at", F.col("to"))
    size = F.col("to") - F.col("from")
    t = F.when(size > 0, (F.col("at") - F.col("from")) / F.when(size > 0, size).otherwise(1.0)).otherwise(1.0)
    whole = F.when(size > 0, size).otherwise(1.0)
    return flat.unionByName(last).select(key, "sample", "at", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"), ((F.col("x2") - F.col("x1")) / whole).alias("tx"), ((F.col("y2") - F.col("y1")) / whole).alias("ty"))


def line_segments(lines: DataFrame, key: str, line: str = "line", part: str | None = None) -> DataFrame:
    """As ``segments`` for rows with an array of (x, y) vertices; with ``part`` the running length goes on over a key's parts in their order."""
    parts = [part] if part else []
    flat = lines.select(key, *parts, F.posexplode(line).alias("_i", "_p")).select(key, *parts, "_i", F.col("_p.x").alias("x1"), F.col("_p.y").alias("y1"))
    w = Window.partitionBy(key, *parts).orderBy("_i")
    ends = flat.withColumn("x2", F.lead("x1").over(w)).withColumn("y2", F.lead("y1").over(w)).where("x2 is not null")
    order = Window.partitionBy(key).orderBy(*parts, "_i")
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumn("seg", F.row_number().over(order) - 1).withColumn("to", F.sum(size).over(run)).withColumn("from", F.col("to") - size).drop("_i")


def points_at(places: DataFrame, segs: DataFrame, key: str, at: str, ids: list[str], x: str = "px", y: str = "py") -> DataFrame:
    """The places (key, ids, ``at``) with the point at that running length; outside the line it is the nearer end.

    The join is on the key and by range, so a place meets only the segments of its line; where two segments meet the first one answers.
    """
    last = F.col("seg") == F.max("seg").over(Window.partitionBy(key))
    edged = segs.select(key, "seg", "x1", "y1", "x2", "y2", "from", "to", last.alias("_last"))
    inside = ((F.col(at) >= F.col("from")) | (F.col("seg") == 0)) & ((F.col(at) <= F.col("to")) | F.col("_last"))
    size = F.col("to") - F.col("from")
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(at) - F.col("from")) / F.when(size > 0, size).otherwise(1.0)))).otherwise(0.0)
    spot = F.struct((F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))
    found = places.join(edged, key).where(inside).groupBy(*dict.fromkeys([key, *ids])).agg(F.min_by(F.struct(spot.alias("p"), F.col(at).alias("at")), "seg").alias("_s"))
    return found.select(*dict.fromkeys([key, *ids]), F.col("_s.at").alias(at), F.col("_s.p.x").alias(x), F.col("_s.p.y").alias(y))


def substrings(segs: DataFrame, cuts: DataFrame, key: str, ids: list[str], part: str | None = None) -> DataFrame:
    """key, ids, line (array of x, y), length: the geometry between two running lengths ``lo`` and ``hi`` of each cut, with the vertices between.

    Bounds are held to the line; a cut without length, or with a null bound, gives no row.  With ``part`` a cut that goes over several parts gives a row a part.
    """
    parts = [part] if part else []
    both = cuts.select(key, *ids, F.least("lo", "hi").alias("_lo"), F.greatest("lo", "hi").alias("_hi")).where("lo != hi").join(segs, key).where((F.col("to") > F.col("_lo")) & (F.col("from") < F.col("_hi")) & (F.col("to") > F.col("from")))
    size = F.col("to") - F.col("from")
    point = lambda bound: F.struct((F.col("x1") + (bound - F.col("from")) / size * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + (bound - F.col("from")) / size * (F.col("y2") - F.col("y1"))).alias("y"))
    start = F.when(F.col("_lo") > F.col("from"), point(F.col("_lo"))).otherwise(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    end = F.when(F.col("_hi") < F.col("to"), point(F.col("_hi"))).otherwise(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    clipped = both.select(key, *ids, *parts, "seg", start.alias("a"), end.alias("b"), (F.least("_hi", "to") - F.greatest("_lo", "from")).alias("size"))
    rows = F.sort_array(F.collect_list(F.struct("seg", "a", "b")))
    return clipped.groupBy(key, *ids, *parts).agg(rows.alias("_r"), F.sum("size").alias("length")).select(key, *ids, *parts, F.concat(F.array(F.element_at("_r", 1)["a"]), F.transform("_r", lambda r: r["b"])).alias("line"), "length")


def prefixes(segs: DataFrame, key: str, progress: Column | float, part: str | None = None) -> DataFrame:
    """key, line, length: the first share of each line (of all its parts together, a row a part that is reached); all of it from 1 on, nothing at 0."""
    share = progress if isinstance(progress, Column) else F.lit(float(progress))
    cuts = segs.groupBy(key).agg(F.max("to").alias("_n")).select(key, F.lit(0.0).alias("lo"), F.when(share >= 1, F.col("_n")).otherwise(F.col("_n") * share).alias("hi"))
    return substrings(segs, cuts, key, [], part)


def tangents(places: DataFrame, segs: DataFrame, key: str, at: str, ids: list[str], step: float) -> DataFrame:
    """key, ids, ``at``, dx, dy: the direction of a line around a running length, between two places half a step before and behind it.

    The half is held between 0.5 and half the line, and both places to the line, so a direction near an end is that of the end.
    """
    size = segs.groupBy(key).agg(F.max("to").alias("_n"))
    half = F.least(F.lit(max(step / 2, 0.5)), F.greatest(F.col("_n") / 2, F.lit(0.5)))
    both = places.join(size, key).select(key, *ids, at, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.greatest(F.lit(0.0), F.col(at) - half).alias("p")), F.struct(F.lit(1).alias("side"), F.least(F.col("_n"), F.col(at) + half).alias("p")))).alias("_e")).select(key, *ids, F.col(at).alias("_at"), "_e.side", F.col("_e.p").alias("_p"))
    spots = points_at(both, segs, key, "_p", [*ids, "_at", "side"])
    pick = lambda c, k: F.max(F.when(F.col("side") == k, F.col(c)))
    return spots.groupBy(*dict.fromkeys([key, *ids]), F.col("_at").alias(at)).agg((pick("px", 1) - pick("px", 0)).alias("dx"), (pick("py", 1) - pick("py", 0)).alias("dy"))
