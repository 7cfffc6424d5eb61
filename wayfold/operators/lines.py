"""Line merge: lines that alone share an end become one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.model import LINE
from wayfold.operators.components import connected_components, cut
from wayfold.session import ship


#: Lines of a key that are walked at once, and of a task's group.
HELD, PORTION = 1 << 15, 1 << 13


def explode_parts(rows: DataFrame, id_col: str, parts: str) -> DataFrame:
    """A row a part with its number, parts of fewer than two vertices left out; the part's id is the feature's and the number."""
    flat = rows.select("*", F.posexplode(parts).alias("part", "line")).where(F.size("line") > 1)
    return flat.withColumn("part_id", F.concat_ws(":", F.col(id_col).cast("string"), F.col("part").cast("string")))


def chain(lines: dict[object, list[tuple[float, float]]], joints: dict[object, tuple[bool, bool]] | None = None) -> list[list[tuple[float, float]]]:
    """Lines joined where exactly two ends meet; a closed ring starts at its smallest line.  Vertices are kept, the joint once.

    joints: for each line whether its first and last end may be joined, where more lines meet than the ones given.
    """
    at: dict[tuple[float, float], list] = {}
    for k in sorted(lines):
        for end in (0, 1):
            if joints is None or joints[k][end]:
                at.setdefault(lines[k][-end], []).append((k, end))
    partner = {}
    for ends in at.values():
        if len(ends) == 2 and ends[0][0] != ends[1][0]:
            partner[ends[0]], partner[ends[1]] = ends[1], ends[0]
    left, out = set(lines), []
    for rings in (False, True):
        for k in sorted(lines):
            for end in (0, 1):
                if k not in left or (not rings and (k, end) in partner):
                    continue
                path: list[tuple[float, float]] = []
                now = (k, end)
                while now and now[0] in left:
                    left.discard(now[0])
                    one = lines[now[0]][:: -1 if now[1] else 1]
                    path += one[1 if path else 0 :]
                    now = partner.get((now[0], 1 - now[1]))
                out.append(path)
    return out


def merge_lines(lines: DataFrame, key: str, id_col: str = "id", line: str = "line") -> DataFrame:
    """key, line (array of x, y): the lines of each key merged where two ends alone meet; lines of fewer than two vertices stay as they are.

    Junctions of three ends or more, and ends that no other meets, connect nothing.  A key of up to ``HELD`` lines that meet is walked at once, of a larger one
    each connected group by itself, and a task takes many of them.
    """
    both = F.array(F.struct(F.lit(0).alias("end"), F.get(line, F.lit(0)).alias("p")), F.struct(F.lit(1).alias("end"), F.get(line, F.size(line) - 1).alias("p")))
    ends = lines.where(F.size(line) > 1).select(key, id_col, F.explode(both).alias("e")).select(key, id_col, "e.end", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))
    met = cut(ends.groupBy(key, "x", "y").agg(F.count("*").alias("n"), F.min(F.struct(id_col, "end")).alias("a"), F.max(F.struct(id_col, "end")).alias("b")).where((F.col("n") == 2) & (F.col(f"a.{id_col}") != F.col(f"b.{id_col}"))).select(key, "a", "b"))
    joined = met.select(key, F.explode(F.array("a", "b")).alias("e")).select(key, F.col(f"e.{id_col}").alias(id_col), "e.end")
    marks = joined.groupBy(key, id_col).agg(F.max(F.col("end") == 0).alias("_first"), F.max(F.col("end") == 1).alias("_last"))
    sizes = cut(marks.groupBy(key).agg(F.count("*").alias("_n")))
    most, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    linked = lines.select(key, id_col, line).join(marks, [key, id_col]).withColumn("_group", F.lit(""))
    if (most or 0) > HELD:
        crowded = sizes.where(F.col("_n") > HELD).select(key)
        pair = lambda side: F.struct(F.col(key), F.col(f"{side}.{id_col}").alias(id_col))
        found = connected_components(met.join(crowded, key, "left_semi").select(pair("a").alias("a"), pair("b").alias("b"))).select(F.col(f"node.{key}").alias(key), F.col(f"node.{id_col}").alias(id_col), F.concat(F.lit("c"), F.col(f"component.{id_col}")).alias("_of"))
        linked = linked.join(found, [key, id_col], "left").withColumn("_group", F.coalesce("_of", "_group")).drop("_of")
    kinds = dict(lines.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups: dict[tuple, tuple[dict, dict]] = {}
        for k, of, name, x, y, first, last in zip(rows[key], rows["_group"], rows[id_col], rows["_x"], rows["_y"], rows["_first"], rows["_last"], strict=True):
            some, joints = groups.setdefault((k, of), ({}, {}))
            some[name], joints[name] = list(zip(x.tolist(), y.tolist(), strict=True)), (bool(first), bool(last))
        merged = [(k, m) for (k, _), (some, joints) in groups.items() for m in chain(some, joints)]
        return pd.DataFrame({key: pd.Series([k for k, _ in merged], dtype=rows[key].dtype), "_x": [[x for x, _ in m] for _, m in merged], "_y": [[y for _, y in m] for _, m in merged]})

    ship(lines.sparkSession)
    least = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = linked.withColumn("_bucket", F.pmod(F.xxhash64(key, "_group"), F.lit(max(least, (total or 0) // PORTION))))
    flat = dealt.select("_bucket", key, "_group", id_col, F.transform(line, lambda p: p["x"].cast("double")).alias("_x"), F.transform(line, lambda p: p["y"].cast("double")).alias("_y"), "_first", "_last")
    walked = flat.groupBy("_bucket").applyInPandas(run, f"{key} {kinds[key]}, _x array<double>, _y array<double>")
    whole = walked.select(key, F.zip_with("_x", "_y", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).cast(LINE).alias("line"))
    alone = lines.join(marks, [key, id_col], "left_anti").select(key, F.col(line).cast(LINE).alias("line"))
    return whole.unionByName(alone)
