"""Where a line's label may stand: anchors at shares of its length, scored by how straight the line is under the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import polyline

#: Shares of the length in the order of preference, points under a label, weight of the middle, usable share of the screen's height.
FRACTIONS = (0.5, 0.35, 0.65, 0.2, 0.8, 0.1, 0.9)
SAMPLES, MIDDLE, SAFE = 9, 0.08, 0.65


def anchors(segs: DataFrame, labels: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """key, fraction, x, y, bearing, straightness, score, w, h (of the upright box) and anchor (0 the best) of every anchor on a screen of that size.

    segs: the line on screen, with running lengths.  labels: key, width, height of the text.  An anchor needs the label's whole width on the line and its
    box on the usable screen.  The bearing is the main axis of the points under the label, from -90 to 90 degrees (0 where they all coincide); straightness is
    the axis' share of their spread.  Equal scores keep the order of ``FRACTIONS``.
    """
    size = segs.groupBy(key).agg(F.max("to").alias("_n"))
    shares = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(f).alias("fraction")) for i, f in enumerate(FRACTIONS)])
    each = labels.join(size, key).select(key, F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h"), "_n", F.explode(shares).alias("_f")).select(key, "_w", "_h", "_n", "_f.rank", "_f.fraction")
    start = F.col("_n") * F.col("fraction") - F.col("_w") / 2
    fits = each.withColumn("_from", start).where((F.col("_from") >= 0) & (F.col("_from") + F.col("_w") <= F.col("_n")))
    spots = fits.select(key, "rank", "_from", "_w", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("k")).withColumn("at", F.col("_from") + F.col("_w") * F.col("k") / (SAMPLES - 1))
    points = polyline.points_at(spots.select(key, "rank", "k", "at"), segs, key, "at", ["rank", "k"])
    centre = F.col("k") == SAMPLES // 2
    spread = points.groupBy(key, "rank").agg(
        F.var_pop("px").alias("xx"),
        F.var_pop("py").alias("yy"),
        F.covar_pop("px", "py").alias("xy"),
        F.max(F.when(centre, F.col("px"))).alias("x"),
        F.max(F.when(centre, F.col("py"))).alias("y"),
    )
    angle = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    along = F.col("xx") * F.pow(F.cos("a"), 2) + 2 * F.col("xy") * F.cos("a") * F.sin("a") + F.col("yy") * F.pow(F.sin("a"), 2)
    some = F.col("xx") + F.col("yy") > 1e-12
    judged = (
        spread.withColumn("a", F.when(some, angle).otherwise(0.0))
        .withColumn("straightness", F.when(some, along / F.when(some, F.col("xx") + F.col("yy")).otherwise(1.0)).otherwise(0.0))
        .join(fits.select(key, "rank", "fraction", "_w", "_h"), [key, "rank"])
        .withColumn("score", F.round(F.col("straightness") + MIDDLE * (1 - F.abs(F.col("fraction") - 0.5) * 2), 9))
        .withColumn("w", F.abs(F.col("_w") * F.cos("a")) + F.abs(F.col("_h") * F.sin("a")))
        .withColumn("h", F.abs(F.col("_w") * F.sin("a")) + F.abs(F.col("_h") * F.cos("a")))
    )
    x, y, w, h = map(F.col, "xywh")
    inside = judged.where((x - w / 2 >= 0) & (x + w / 2 <= width) & (y - h / 2 >= 0) & (y + h / 2 <= height * SAFE))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "rank")
    return inside.select(key, "fraction", "x", "y", F.degrees("a").alias("bearing"), "straightness", "score", "w", "h", (F.row_number().over(best) - 1).alias("anchor"))
