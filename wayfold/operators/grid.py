"""Distance joins as equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators.components import cut, shuffled
from wayfold.session import ship


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def grid_distance_join(points: DataFrame, others: DataFrame, radius: float, x: str = "x", y: str = "y", ox: str = "ox", oy: str = "oy", distance: str = "distance") -> DataFrame:
    """All pairs of a point and another within the radius, with their distance.

    The others are put into the nine cells around their own, of the radius' size; the points stay in one cell.  The join is
    an equi-join on the cell, and no pair comes twice.  Its rows are many for the input's size, which adaptive execution can't know: it would
    leave them to a few tasks.  So both sides are dealt to a fixed number of partitions, and of a cell with more than ``BLOCK`` points to several.
    """
    around = F.array(*[F.struct((cell(F.col(ox), radius) + i).alias("_cx"), (cell(F.col(oy), radius) + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = others.withColumn("_cell", F.explode(around)).select(*others.columns, F.col("_cell._cx"), F.col("_cell._cy"))
    here = points.withColumn("_cx", cell(F.col(x), radius)).withColumn("_cy", cell(F.col(y), radius))
    parts, place = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["_cx", "_cy", "_i"]
    sizes = here.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    here = here.join(sizes, ["_cx", "_cy"]).withColumn("_i", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in points.columns)), F.col("_n")).cast("int")).drop("_n").repartition(parts, *place)
    spread = spread.join(sizes, ["_cx", "_cy"]).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n").repartition(parts, *place)
    dx, dy = F.col(x) - F.col(ox), F.col(y) - F.col(oy)
    near = dx * dx + dy * dy <= F.lit(radius * radius * (1 + 1e-9) + 1e-300)  # cheap, and lets no pair go; most pairs of a cell end here
    return here.join(spread, place).where(near).withColumn(distance, F.hypot(dx, dy)).where(F.col(distance) <= radius).drop(*place)


def along(segments: DataFrame, radius: float, size: float, ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """The segments, once for each cell (``_cx``, ``_cy``) that their course, widened by the radius, passes."""
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    columns = F.sequence(cell(F.least(x1, x2) - radius, size), cell(F.greatest(x1, x2) + radius, size))
    wide = segments.withColumn("_cx", F.explode(columns))
    dx = x2 - x1
    at = lambda edge: F.when(dx == 0, F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - x1) / F.when(dx == 0, F.lit(1.0)).otherwise(dx))))
    ya = F.coalesce(y1 + at(F.col("_cx") * size - radius) * (y2 - y1), y1)
    yb = F.coalesce(y1 + at((F.col("_cx") + 1) * size + radius) * (y2 - y1), y2)
    return wide.withColumn("_cy", F.explode(F.sequence(cell(F.least(ya, yb) - radius, size), cell(F.greatest(ya, yb) + radius, size))))


def grid_segment_join(points: DataFrame, segments: DataFrame, radius: float, distance: Column, x: str = "x", y: str = "y", ends: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), size: float | None = None) -> DataFrame:
    """All pairs of a point and a segment within the radius; ``distance`` is an expression over both sides' columns.

    A segment is put into every cell that its bounding box, widened by the radius, meets column by column along its longer
    course: for each column of cells only the rows that the segment itself passes, so a long slanting segment
    takes cells in proportion to its length.
    """
    size = size or radius
    wide = along(segments, radius, size, ends)
    here = points.withColumn("_cx", cell(F.col(x), size)).withColumn("_cy", cell(F.col(y), size))
    return here.join(wide, ["_cx", "_cy"]).withColumn("distance", distance).where(F.col("distance") <= radius).drop("_cx", "_cy")


def segments_within(ones: DataFrame, others: DataFrame, radius: float, keys: list[str], okeys: list[str]) -> DataFrame:
    """Distinct keys of both sides where a segment of the one is within the radius of a segment of the other, with their least distance.

    Both have x1, y1, x2, y2; the others' columns are renamed.  The ones go to the cells that they pass, the others to those that they pass
    widened by the radius, so two segments that come near in their insides, or cross, meet in a cell.  Where the others have no keys and are ``FEW``, every task holds them.
    """
    if not okeys and (held := _held(others)) is not None and len(held):
        return near_few(ones, held, radius, keys)
    here = along(ones.select(*keys, "x1", "y1", "x2", "y2"), 0.0, radius)
    there = along(others.select(*okeys, "x1", "y1", "x2", "y2"), radius, radius).withColumnsRenamed({"x1": "_x1", "y1": "_y1", "x2": "_x2", "y2": "_y2"})
    far = g.segment_segment(tuple(map(F.col, ("x1", "y1", "x2", "y2"))), tuple(map(F.col, ("_x1", "_y1", "_x2", "_y2"))))
    return here.join(there, ["_cx", "_cy"]).withColumn("distance", far).where(F.col("distance") <= radius).groupBy(*keys, *okeys).agg(F.min("distance").alias("distance"))


#: Sides of a cell's children in the tree of cells, as a power of two.
_STEP = 2


def _cells_of(segments: DataFrame, size: float) -> list[DataFrame]:
    """Cells that segments pass, at every level of a tree: ``cx``, ``cy`` at a level are those of its children shifted.  The last level has four cells at most."""
    levels = [cut(along(segments.select("x1", "y1", "x2", "y2"), 0.0, size).select(F.col("_cx").alias("cx"), F.col("_cy").alias("cy")).distinct())]
    w, s, e, n = levels[0].agg(F.min("cx"), F.min("cy"), F.max("cx"), F.max("cy")).first()
    while max(e - w, n - s) > 1:
        w, s, e, n = (v >> _STEP for v in (w, s, e, n))
        levels.append(levels[-1].select(F.shiftright("cx", _STEP).alias("cx"), F.shiftright("cy", _STEP).alias("cy")).distinct())
    return levels


def _far(points: DataFrame, segments: DataFrame, keys: list[str], size: float, into: str) -> DataFrame:
    """keys and the distance to the nearest segment of points that may lie far from any, by descent through a tree of occupied cells.

    At each level a point keeps the cells that may hold its nearest segment: those whose near side is not beyond the far side of another one.  So it
    meets a handful of cells a level and the segments of a few of the smallest, however far away they are.
    """
    levels = _cells_of(segments, size)
    top = [(r.cx, r.cy) for r in levels[-1].collect()]  # four at most
    now = points.select(*keys, "x", "y", F.explode(F.array(*[F.struct(F.lit(cx).cast("long").alias("cx"), F.lit(cy).cast("long").alias("cy")) for cx, cy in top])).alias("_c")).select(*keys, "x", "y", "_c.cx", "_c.cy")
    mine = Window.partitionBy(*keys)
    for level in reversed(range(len(levels) - 1)):
        side = size * 2.0 ** (_STEP * level)
        children = levels[level].select(F.col("cx").alias("_kx"), F.col("cy").alias("_ky"), F.shiftright("cx", _STEP).alias("cx"), F.shiftright("cy", _STEP).alias("cy"))
        gap = lambda v, k, s=side: F.greatest(F.lit(0.0), F.col(k) * s - F.col(v), F.col(v) - (F.col(k) + 1) * s)
        reach = lambda v, k, s=side: F.greatest(F.abs(F.col(v) - F.col(k) * s), F.abs((F.col(k) + 1) * s - F.col(v)))
        wide = now.join(children, ["cx", "cy"]).withColumn("_near", F.hypot(gap("x", "_kx"), gap("y", "_ky"))).withColumn("_bound", F.min(F.hypot(reach("x", "_kx"), reach("y", "_ky"))).over(mine))
        now = cut(wide.where(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).select(*keys, "x", "y", F.col("_kx").alias("cx"), F.col("_ky").alias("cy")))
    passed = along(segments.select("x1", "y1", "x2", "y2"), 0.0, size).withColumnsRenamed({"_cx": "cx", "_cy": "cy"})
    d = g.point_segment(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    return now.join(passed, ["cx", "cy"]).groupBy(*keys).agg(F.min(d).alias(into))


#: Segments that every task may hold at once.
FEW = 4096


def _held(segments: DataFrame) -> np.ndarray | None:
    """x1, y1, x2, y2 of segments with finite coordinates, a row each; none where they are more than ``FEW``."""
    finite = reduce(Column.__and__, [F.coalesce(F.abs(F.col(c)) < 1e300, F.lit(False)) for c in ("x1", "y1", "x2", "y2")])
    rows = segments.where(finite).select("x1", "y1", "x2", "y2").limit(FEW + 1).collect()
    return np.array(rows, float).reshape(-1, 4) if len(rows) <= FEW else None


def _portions(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """The rows in portions whose matrix with n others stays small."""
    step = max(1, (1 << 17) // max(1, n))
    for rows in frames:
        for k in range(0, len(rows), step):
            yield rows.iloc[k : k + step]


def distance_to_few(points: DataFrame, held: np.ndarray, keys: list[str], into: str) -> DataFrame:
    """keys and the distance of each point (x, y) to the nearest of few segments, in the rows' own tasks; null where a coordinate is null or infinite."""
    schema = ", ".join(f"`{c}` {t}" for c, t in points.select(*keys).dtypes) + f", {into} double"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _portions(frames, len(held)):
            x, y = rows["_px"].to_numpy(float), rows["_py"].to_numpy(float)
            sound = (np.abs(x) < 1e300) & (np.abs(y) < 1e300)
            d = to_segments(np.where(sound, x, 0.0)[:, None], np.where(sound, y, 0.0)[:, None], *held.T).min(1)
            yield rows[keys].assign(**{into: pd.Series(d, rows.index).where(sound)})

    ship(points.sparkSession)
    return points.select(*keys, F.col("x").alias("_px"), F.col("y").alias("_py")).mapInPandas(work, schema).withColumn(into, F.when(~F.isnan(into), F.col(into)))


def near_few(ones: DataFrame, held: np.ndarray, radius: float, keys: list[str]) -> DataFrame:
    """keys of segments within the radius of any of few segments, with their least distance; as ``segments_within``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in ones.select(*keys).dtypes) + ", distance double"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _portions(frames, len(held)):
            a, b = [rows[c].to_numpy(float)[:, None] for c in ("x1", "y1", "x2", "y2")], list(held.T)
            d = segment_gaps(a, b).min(1)
            yield rows.loc[d <= radius, keys].assign(distance=d[d <= radius])

    ship(ones.sparkSession)
    return ones.select(*keys, "x1", "y1", "x2", "y2").mapInPandas(work, schema).groupBy(*keys).agg(F.min("distance").alias("distance"))


def segment_gaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Distances of segments (x1, y1, x2, y2), as ``geometry.segment_segment`` has them; the arrays are broadcast."""
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    cross = (side(a, b[0], b[1]) * side(a, b[2], b[3]) < 0) & (side(b, a[0], a[1]) * side(b, a[2], a[3]) < 0)
    ends = [to_segments(a[0], a[1], *b), to_segments(a[2], a[3], *b), to_segments(b[0], b[1], *a), to_segments(b[2], b[3], *a)]
    return np.where(cross, 0.0, reduce(np.minimum, ends))


def nearest_distance(points: DataFrame, segments: DataFrame, keys: list[str], radius: float, into: str = "distance") -> DataFrame:
    """keys and the distance to the nearest segment, of every point (x, y), however far; no rows without segments.

    Where segments are ``FEW``, every task holds them all.  Else points with a segment within the radius are answered by a join on cells; the others by
    descent through a tree of the cells that segments pass.  A point with a null or infinite coordinate, or none at all, has a null distance; segments with such a coordinate are left out.
    """
    d = g.point_segment(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    finite = lambda *names: reduce(Column.__and__, [F.coalesce(F.abs(F.col(c)) < 1e300, F.lit(False)) for c in names])
    sound = segments.where(finite("x1", "y1", "x2", "y2"))
    every = points.select(*keys, "x", "y")
    nothing = F.lit(None).cast("double").alias(into)
    if sound.isEmpty():
        return every.select(*keys, nothing).limit(0)
    held = _held(sound)
    if held is not None:
        return distance_to_few(every, held, keys, into)
    placed = every.where(finite("x", "y"))
    near = cut(placed.join(grid_segment_join(placed, sound, radius, d).groupBy(*keys).agg(F.min("distance").alias(into)), keys, "left"))
    left = near.where(F.col(into).isNull()).select(*keys, "x", "y")
    found = near.where(F.col(into).isNotNull()).select(*keys, into).unionByName(every.where(~finite("x", "y")).select(*keys, nothing))
    return found if left.isEmpty() else found.unionByName(_far(left, sound, keys, radius, into))


#: Points of a cell, and others around it, that are compared at once.
BLOCK = 8192
#: Cells whose sizes every task may hold.
CELLS = 1 << 16


def sent(cells: DataFrame) -> DataFrame:
    """A row a cell, for a join: sent to every task where they are at most ``CELLS``, else shuffled."""
    return F.broadcast(cells) if cells.count() <= CELLS else shuffled(cells)


def near_blocks(points: DataFrame, others: DataFrame, radius: float, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, size: float | None = None) -> DataFrame:
    """What ``work`` makes of points (x, y) and others (ox, oy), block by block; each pair within the radius meets in one call.

    For what needs no row a pair: a minimum, a count, or whether there is any.  Cells are those of ``grid_distance_join``, or of a size above the radius; what a cell has on either
    side is dealt into blocks of some ``BLOCK`` rows, so a crowded cell is many tasks and no group grows with it.  The results of a point's blocks
    are the caller's to merge.  All columns but the coordinates need other names on the two sides and no nulls.
    """
    size = max(radius, size or radius)
    around = F.array(*[F.struct((cell(F.col("ox"), size) + i).alias("_cx"), (cell(F.col("oy"), size) + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = others.withColumn("_cell", F.explode(around)).select(*others.columns, F.col("_cell._cx"), F.col("_cell._cy"))
    here = points.withColumn("_cx", cell(F.col("x"), size)).withColumn("_cy", cell(F.col("y"), size))
    return in_blocks(here, spread, points.columns, others.columns, work, schema)


def in_blocks(here: DataFrame, there: DataFrame, mine: list[str], theirs: list[str], work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = 0) -> DataFrame:
    """What ``work`` makes of two sides whose rows are in cells (``_cx``, ``_cy``) already, block by block; rows of one cell meet in one call."""
    many = lambda rows, name: rows.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / (block or BLOCK)).cast("int").alias(name))
    sizes = cut(many(here, "_np").join(many(there, "_no"), ["_cx", "_cy"]))
    cells, blocks = sizes.agg(F.count("*"), F.sum(F.col("_np") * F.col("_no"))).first()
    blocks, sizes = blocks or 1, F.broadcast(sizes) if cells <= CELLS else shuffled(sizes)  # never the rows themselves, whose number Spark doesn't know
    parts = min(blocks, max(int(here.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 32))  # blocks are few bytes and much work, which adaptive execution can't know
    empty = lambda rows, names: [F.lit("" if t == "string" else 0).cast(t).alias(c) for c, t in rows.select(*names).dtypes]
    deal = lambda names, n: F.pmod(F.xxhash64(*names), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = here.join(sizes, ["_cx", "_cy"]).select("_cx", "_cy", deal(mine, "_np").alias("_i"), every("_no").alias("_j"), F.lit(True).alias("_point"), *mine, *empty(there, theirs))
    two = there.join(sizes, ["_cx", "_cy"]).select("_cx", "_cy", every("_np").alias("_i"), deal(theirs, "_no").alias("_j"), F.lit(False).alias("_point"), *empty(here, mine), *theirs)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["_point"].to_numpy(bool)
        return work(rows.loc[side, mine].reset_index(drop=True), rows.loc[~side, theirs].reset_index(drop=True))

    ship(here.sparkSession)
    place = ["_cx", "_cy", "_i", "_j"]
    return one.unionByName(two).repartition(int(parts), *place).groupBy(*place).applyInPandas(compare, schema)


def distances(points: pd.DataFrame, others: pd.DataFrame, radius: float, portion: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the points, rows of the others and the matrix of their distances, in portions; all pairs within the radius are in one."""
    px, py, ox, oy = (side[c].to_numpy(float) for side, c in ((points, "x"), (points, "y"), (others, "ox"), (others, "oy")))
    p, o = np.argsort(px, kind="stable"), np.argsort(ox, kind="stable")
    step = max(1, portion // max(1, len(o)))
    for k in range(0, len(p) if len(o) else 0, step):
        rows = p[k : k + step]
        wide = radius * (1 + 1e-9) + 1e-9
        columns = o[np.searchsorted(ox, px[rows[0]] - wide, sorter=o) : np.searchsorted(ox, px[rows[-1]] + wide, "right", sorter=o)]
        if len(columns):
            dx, dy = px[rows, None] - ox[columns], py[rows, None] - oy[columns]
            yield rows, columns, np.sqrt(dx * dx + dy * dy)


def to_segments(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Distances of points to segments, as ``geometry.point_segment`` has them; the arrays are broadcast."""
    dx, dy = x2 - x1, y2 - y1
    whole = dx * dx + dy * dy
    t = np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(whole == 0, 1.0, whole), 0.0, 1.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return np.sqrt(ex * ex + ey * ey)


def undirected_angles(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Angles of two lines in degrees, as ``geometry.undirected_angle`` has them."""
    whole = np.hypot(ax, ay) * np.hypot(bx, by)
    return np.where(whole == 0, 90.0, np.degrees(np.arccos(np.minimum(1.0, np.abs(ax * bx + ay * by) / np.where(whole == 0, 1.0, whole)))))


def nearest_within(points: DataFrame, others: DataFrame, radius: float, key: str, okey: str) -> DataFrame:
    """key, okey, distance, n: of each point (key, x, y) the nearest other (okey, ox, oy) within the radius, the smaller key among equals, and how many there are.

    Keys are whole numbers; points with none have no row.
    """

    def work(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        keys, names = p[key].to_numpy(np.int64), o[okey].to_numpy(np.int64)
        out = [(keys[:0], names[:0], np.zeros(0), keys[:0])]
        for rows, columns, d in distances(p, o, radius):
            least, n = d.min(1), (d <= radius).sum(1)
            best = np.where(d == least[:, None], names[columns], np.iinfo(np.int64).max).min(1)
            hit = n > 0
            out.append((keys[rows[hit]], best[hit], least[hit], n[hit]))
        return pd.DataFrame(dict(zip((key, okey, "distance", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = near_blocks(points.select(key, "x", "y").where(F.col(key).isNotNull()), others.select(okey, "ox", "oy").where(F.col(okey).isNotNull()), radius, work, f"{key} long, {okey} long, distance double, n long")
    return found.groupBy(key).agg(F.min_by(okey, F.struct("distance", okey)).alias(okey), F.min("distance").alias("distance"), F.sum("n").alias("n"))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the smallest label of each class that the pairs of rows join to all that have a label of it."""
    names, at = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    to = np.arange(len(label))
    to[names] = names[root]
    label[:] = to[label]


def linked_within(points: DataFrame, others: DataFrame, radius: float, a: str, b: str) -> DataFrame:
    """a, b: edges with the same components as all pairs of a point (a, x, y) and an other (b, ox, oy) within the radius.

    Each block gives one edge for a node that has a pair, to the first of what the block connects it to.
    """

    def work(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        names = np.concatenate([p[a].to_numpy(object), o[b].to_numpy(object)])
        label, met = np.arange(len(names)), np.zeros(len(names), bool)
        for rows, columns, d in distances(p, o, radius):
            near = d <= radius
            met[rows[near.any(1)]] = met[len(p) + columns[near.any(0)]] = True
            i, j = np.nonzero(near & (label[rows][:, None] != label[len(p) + columns]))
            if len(i):
                merge(label, rows[i], len(p) + columns[j])
        return pd.DataFrame({"a": names[met], "b": names[label[met]]})

    return near_blocks(points.select(a, "x", "y").where(F.col(a).isNotNull()), others.select(b, "ox", "oy").where(F.col(b).isNotNull()), radius, work, "a string, b string")


#: Starts of paths that are followed at once.
STARTS = 512


def paths_within(points: DataFrame, others: DataFrame, radius: float, key: str, okey: str) -> DataFrame:
    """okey, n_edges, n_paths, n_ends: the simple paths of one to three edges from each other (okey, ox, oy), and their distinct ends.

    Edges join a point (key, x, y) and an other within the radius; keys are whole numbers, each once a side.  A path of three edges stays within three
    radii, so what lies around a cell of that size is compared as matrices, in portions, for a block of starts: no row an edge and none a path.
    """
    size, sides = 3 * radius, "_kind int, _key long, _x double, _y double"
    finite = lambda x, y: (F.abs(F.col(x)) < 1e300) & (F.abs(F.col(y)) < 1e300)
    some = lambda rows, k, name, x, y: rows.where(F.col(name).isNotNull() & finite(x, y)).select(F.lit(k).alias("_kind"), F.col(name).cast("long").alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    there, here = some(others, 1, okey, "ox", "oy"), some(points, 2, key, "x", "y")
    starts = there.withColumn("_kind", F.lit(0)).withColumn("_cx", cell(F.col("_x"), size)).withColumn("_cy", cell(F.col("_y"), size))
    sizes = cut(starts.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / STARTS).cast("int").alias("_n")))
    around = F.array(*[F.struct((cell(F.col("_x"), size) + i).alias("_cx"), (cell(F.col("_y"), size) + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    names = [c.split()[0] for c in sides.split(", ")]
    near = there.unionByName(here).select(*names, F.explode(around).alias("_c")).select(*names, "_c._cx", "_c._cy").join(sizes, ["_cx", "_cy"]).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    mine = starts.join(sizes, ["_cx", "_cy"]).withColumn("_i", F.pmod(F.xxhash64("_key"), F.col("_n")).cast("int"))
    blocks = sizes.agg(F.sum("_n")).first()[0] or 1
    parts = min(blocks, max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 8))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        k, keys, x, y = (rows[c].to_numpy() for c in names)
        s = np.flatnonzero(k == 0)

        def inside(kind: int, reach: float) -> np.ndarray:
            reach = reach * (1 + 1e-9) + 1e-9
            return np.flatnonzero((k == kind) & (x >= x[s].min() - reach) & (x <= x[s].max() + reach) & (y >= y[s].min() - reach) & (y <= y[s].max() + reach)) if len(s) else s

        def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            dx, dy = x[a, None] - x[b], y[a, None] - y[b]
            return np.sqrt(dx * dx + dy * dy) <= radius

        mid, ends = inside(1, 2 * radius), inside(2, 3 * radius)
        step = max(1, (1 << 21) // max(1, len(mid)))
        portions = [ends[n : n + step] for n in range(0, len(ends), step)]
        one, common, degree = np.zeros(len(s), np.int64), np.zeros((len(s), len(mid)), np.int64), np.zeros(len(mid), np.int64)
        for c in portions:
            first, second = met(s, c), met(mid, c)
            one += first.sum(1)
            degree += second.sum(1)
            common += (first.astype(np.float32) @ second.T.astype(np.float32)).astype(np.int64)  # whole numbers up to a portion's size are exact
        common[keys[s][:, None] == keys[mid]] = 0
        use = common.any(0)
        common, mid, degree = common[:, use], mid[use], degree[use]
        any_, more, last = (common > 0).astype(np.float32), (common > 1).astype(np.float32), np.zeros(len(s), np.int64)
        for c in portions if len(mid) else []:
            second = met(mid, c).astype(np.float32)
            # an end that the start itself is near needs a middle that shares another point with the start
            last += np.where(met(s, c), more @ second, any_ @ second).astype(bool).sum(1)
        n = [one, common.sum(1), (common * (degree - 1)).sum(1)]
        m = [one, (common > 0).sum(1), last]
        found = pd.DataFrame({okey: np.tile(keys[s], 3), "n_edges": np.repeat([1, 2, 3], len(s)), "n_paths": np.concatenate(n), "n_ends": np.concatenate(m)})
        return found[found["n_paths"] > 0]

    ship(points.sparkSession)
    place = ["_cx", "_cy", "_i"]
    both = mine.select(*place, *names).unionByName(near.select(*place, *names))
    return both.repartition(int(parts), *place).groupBy(*place).applyInPandas(count, f"{okey} long, n_edges long, n_paths long, n_ends long")


def linked_segments(segments: DataFrame, radius: float, size: float, key: str = "a") -> DataFrame:
    """a, b: edges with the same components as all pairs of lines (key, x1, y1, x2, y2) that come within the radius of each other, insides included.

    In a block a segment is compared only with those that nothing has reached yet, so where much touches little is compared; each line gives one edge.
    """
    kind = dict(segments.dtypes)[key]
    ends = ["x1", "y1", "x2", "y2"]
    here = along(segments.select(key, *ends), 0.0, size).withColumnRenamed(key, "_a")
    there = along(segments.select(F.col(key).alias("_b"), *ends), radius, size).withColumnsRenamed({c: f"_{c}" for c in ends})

    def work(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        names, node = np.unique(np.concatenate([p["_a"].to_numpy(), o["_b"].to_numpy()]), return_inverse=True)
        corners = [np.concatenate([p[c].to_numpy(float), o[f"_{c}"].to_numpy(float)]) for c in ends]
        first = np.arange(len(node)) < len(p)  # only segments of different sides are compared, as in a join
        root, left = np.arange(len(names)), np.ones(len(node), bool)
        order = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[order], np.arange(len(names) + 1))
        rest = {True: np.flatnonzero(~first), False: np.flatnonzero(first)}  # on the other side, what nothing has reached yet; it only shrinks
        w, s, e, n_ = (f(corners[k], corners[k + 2]) for f, k in ((np.minimum, 0), (np.minimum, 1), (np.maximum, 0), (np.maximum, 1)))
        wide = radius * (1 + 1e-9) + 1e-9 * max(1.0, *(float(np.fmax.reduce(np.abs(c), initial=0.0)) for c in corners))
        for seed in range(len(names)):
            todo = [seed] if root[seed] == seed and left[order[starts[seed] : starts[seed + 1]]].any() else []
            while todo:
                now = todo.pop()
                rows = order[starts[now] : starts[now + 1]]
                left[rows] = False
                for side in (True, False):
                    a = rows[first[rows] == side]
                    if not len(a) or not len(rest[side]):
                        continue
                    b = rest[side] = rest[side][left[rest[side]]]
                    lo_x, hi_x, lo_y, hi_y = np.fmin.reduce(w[a]) - wide, np.fmax.reduce(e[a]) + wide, np.fmin.reduce(s[a]) - wide, np.fmax.reduce(n_[a]) + wide
                    b = b[(w[b] <= hi_x) & (e[b] >= lo_x) & (s[b] <= hi_y) & (n_[b] >= lo_y)]
                    step = max(1, (1 << 18) // max(1, len(a)))
                    for k in range(0, len(b), step):
                        some = b[k : k + step]
                        some = some[left[some]]
                        close = (segment_gaps([c[a, None] for c in corners], [c[some] for c in corners]) <= radius).any(0)
                        for n in np.unique(node[some[close]]):
                            root[n] = seed
                            left[order[starts[n] : starts[n + 1]]] = False
                            todo.append(int(n))
        return pd.DataFrame({"a": names, "b": names[root]})

    return in_blocks(here, there, ["_a", *ends], ["_b", *(f"_{c}" for c in ends)], work, f"a {kind}, b {kind}").where("a != b").distinct()
