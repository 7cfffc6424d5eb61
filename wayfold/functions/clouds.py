"""Cloud banks of a scene change: seeded numbers in wrapping arithmetic of 32 bits, and the banks' edges and wisps as rows.

The generator's state is a counter, so the k-th number of a seed needs none before it: numbers are plain Columns, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed values of the generator and of the picture.
STRIDE = 0x6D2B79F5
HEIGHT, WISPS = 1080.0, 20
#: No bank has more steps: each is 85 high at least.
STEPS = 13


def _low(n: Column) -> Column:
    return n.bitwiseAND(F.lit(MASK))


def product(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits, by halves so that nothing overflows."""
    high = F.shiftright(a, 16) * b
    return _low(F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b)


def random(seed: Column, k: Column) -> Column:
    """The k-th number (from 0) of a seed, from 0 to below 1."""
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    state = _low(_low(seed.cast("long")) + product(F.lit(STRIDE).cast("long"), _low(k.cast("long") + 1)))
    mixed = lambda v, n, bits: product(v.bitwiseXOR(F.shiftright(v, n)), v.bitwiseOR(F.lit(bits).cast("long")))
    first = once(state, lambda v: mixed(v, 15, 1))
    second = once(first, lambda v: v.bitwiseXOR(_low(v + mixed(v, 7, 61))))
    return once(second, lambda v: v.bitwiseXOR(F.shiftright(v, 14))) / F.lit(4294967296.0)


def edges(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """seed, step, x, y of the stepped edge of each bank, from the top (step 0) to the bottom."""
    s = F.col(seed)
    start = seeds.select(s, F.lit(0).alias("step"), (1030 + random(s, F.lit(0)) * 180).alias("x"), F.lit(0.0).alias("y"))
    k = F.col("step")
    w = Window.partitionBy(seed).orderBy("step")
    down = seeds.select(s, F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")).withColumn("high", 85 + random(s, 2 * k - 1) * 95).withColumn("x", 1010 + random(s, 2 * k) * 220)
    summed = down.withColumn("y", F.sum("high").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("y") - F.col("high") < HEIGHT)
    return start.unionByName(summed.select(s, "step", "x", F.least("y", F.lit(HEIGHT)).alias("y")))


def wisps(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """seed, wisp, x, y, width, height, opacity: the wisps of each bank, whose numbers follow those of its edge."""
    s = F.col(seed)
    used = edges(seeds, seed).groupBy(s).agg((1 + 2 * F.max("step")).alias("used"))
    each = used.select(s, "used", F.explode(F.sequence(F.lit(0), F.lit(WISPS - 1))).alias("wisp"))
    number = lambda j: random(s, F.col("used") + 5 * F.col("wisp") + j)
    return each.select(
        s,
        "wisp",
        (55 + number(0) * 620).alias("x"),
        (F.col("wisp") / WISPS * HEIGHT + (number(1) - 0.5) * 54).alias("y"),
        (170 + number(2) * 410).alias("width"),
        (22 + number(3) * 34).alias("height"),
        (0.18 + number(4) * 0.22).alias("opacity"),
    )
