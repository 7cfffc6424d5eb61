"""Steps that depend on their own earlier choices: plain functions over one part, screen or junction, for grouped Python."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.plans.matching import BRIDGE, SNAP, STEP, follows
from wayfold.plans.matching import cluster_means as cluster_means
from wayfold.session import ship

Point = tuple[float, float]


def runs_of(owners: dict[int, object]) -> list[tuple[object, int, int]]:
    """Owner, start and end (exclusive) of each run of consecutive samples."""
    out: list[tuple[object, int, int]] = []
    for s in sorted(owners):
        if out and out[-1][0] == owners[s] and out[-1][2] == s:
            out[-1] = (out[-1][0], out[-1][1], s + 1)
        else:
            out.append((owners[s], s, s + 1))
    return out


def validate_handoffs(owners: dict[int, object], rank: dict[object, int], candidates: dict[int, list[tuple[float, object]]], touches: Callable[[object, object], bool], bridge: int = BRIDGE, passes: int = 4) -> dict[int, object]:
    """Owners where runs between higher-class neighbours join them at source junctions.

    A run with a higher-class neighbour within the bridge, to which its atom has no junction, is given anew: each sample to the
    candidate with the fewest missing junctions, then the highest class, the least cost and the name; if one is still missing, to none.
    Neighbours are those at the start of a pass; passes go on until nothing changes.
    """
    owners = dict(owners)
    for _ in range(passes):
        before, runs = dict(owners), runs_of(owners)
        for k, (edge, lo, hi) in enumerate(runs):
            near = [runs[k - 1][0]] if k and lo - runs[k - 1][2] <= bridge else []
            near += [runs[k + 1][0]] if k + 1 < len(runs) and runs[k + 1][1] - hi <= bridge else []
            above = [n for n in near if rank[n] < rank[edge]]
            lacks = lambda e, above=above: sum(e != n and not touches(e, n) for n in above)
            if not above or not lacks(edge):
                continue
            for s in range(lo, hi):
                best = min(((lacks(e), rank[e], cost, e) for cost, e in candidates.get(s, ())), default=(1,))
                if best[0] == 0:
                    owners[s] = best[3]
                else:
                    owners.pop(s, None)
        if owners == before:
            break
    return owners


def turn_between(a: Point, b: Point) -> float:
    size = math.hypot(*a) * math.hypot(*b)
    return 180.0 if size == 0 else math.degrees(math.acos(max(-1.0, min(1.0, (a[0] * b[0] + a[1] * b[1]) / size))))


def part_transition(end_owner: object, end_gap: int, end_direction: Point, start_owner: object, start_gap: int, start_direction: Point, lines: dict[object, list[Point]], reference: list[Point], taken: set, most_gap: int = 2, max_turn: float = 60.0, snap: float = SNAP, step: float = STEP) -> tuple | None:
    """The atoms that carry a match from one reference part into the next: one, or else two, that touch both owners and follow the joined ends.

    ``reference`` is the end of the first part and the start of the second.  Gaps above the limit, sharper turns and second candidates give none.
    """
    if end_gap > most_gap or start_gap > most_gap or turn_between(end_direction, start_direction) > max_turn:
        return None
    ends = {k: (v[0], v[-1]) for k, v in lines.items()}
    touch = lambda p, q: any(math.dist(x, y) <= snap for x in ends[p] for y in ends[q])
    if end_owner == start_owner or touch(end_owner, start_owner):
        return ()
    whole = sum(math.dist(a, b) for a, b in zip(reference, reference[1:], strict=False))
    good = [k for k, v in sorted(lines.items(), key=lambda x: str(x[0])) if k not in taken and follows(v, reference, 0.0, whole, step)]
    one = [(k,) for k in good if touch(end_owner, k) and touch(k, start_owner)]
    two = [(j, k) for j in good for k in good if j != k and touch(end_owner, j) and touch(j, k) and touch(k, start_owner)] if not one else []
    found = one or two
    return found[0] if len(found) == 1 else None


def extend_to_junctions(runs: DataFrame, junctions: DataFrame, most: float = 35.0) -> DataFrame:
    """Runs drawn out to the junction with the next one where it is within the limit of both; ``ends`` says which sides were.

    runs: part, run, owner, from_m, to_m.  junctions: part, a, b, at_m, in either order of atoms.
    """
    w = Window.partitionBy("part").orderBy("from_m", "run")
    pairs = runs.select("part", "run", "owner", "to_m", F.lead("run").over(w).alias("next"), F.lead("owner").over(w).alias("next_owner"), F.lead("from_m").over(w).alias("next_from"))
    both = junctions.select("part", "a", "b", "at_m").union(junctions.select("part", "b", "a", "at_m")).withColumnsRenamed({"a": "owner", "b": "next_owner"})
    fit = (F.abs(F.col("at_m") - F.col("to_m")) <= most) & (F.abs(F.col("next_from") - F.col("at_m")) <= most)
    met = pairs.join(both, ["part", "owner", "next_owner"]).where(fit).groupBy("part", "run", "next").agg(F.min_by("at_m", F.abs(F.col("at_m") - (F.col("to_m") + F.col("next_from")) / 2)).alias("at_m"))
    out = runs.join(met.select("part", "run", F.col("at_m").alias("_end")), ["part", "run"], "left").join(met.select("part", F.col("next").alias("run"), F.col("at_m").alias("_start")), ["part", "run"], "left")
    ends = F.concat_ws("+", F.when(F.col("_start").isNotNull(), "start"), F.when(F.col("_end").isNotNull(), "end"))
    return out.withColumn("ends", F.when(ends == "", "interior").otherwise(ends)).withColumn("from_m", F.coalesce("_start", "from_m")).withColumn("to_m", F.coalesce("_end", "to_m")).drop("_start", "_end")


def stitch(fragments: list[list[Point]], most_gap: float = 12.0, max_turn: float = 45.0) -> list[list[Point]]:
    """Fragments joined on screen, the smallest gap first; appending goes before prepending, forward before reversed, then by index."""
    parts = [list(f) for f in fragments if len(f) > 1]
    while True:
        best = None
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                if i == j:
                    continue
                for prepend, reverse in ((False, False), (False, True), (True, False), (True, True)):
                    c = b[::-1] if reverse else b
                    first, second = (c, a) if prepend else (a, c)
                    gap = math.dist(first[-1], second[0])
                    bend = turn_between((first[-1][0] - first[-2][0], first[-1][1] - first[-2][1]), (second[1][0] - second[0][0], second[1][1] - second[0][1]))
                    key = (round(gap, 9), prepend, reverse, i, j)
                    if gap <= most_gap and bend <= max_turn and (best is None or key < best[0]):
                        best = (key, i, j, first + second)
        if best is None:
            return parts
        _, i, j, joined = best
        parts = [joined if k == min(i, j) else p for k, p in enumerate(parts) if k != max(i, j)]


def place_labels(labels: DataFrame, screen: str, order: list[str]) -> DataFrame:
    """Labels that fit: by order, each takes the first of its anchors whose box meets none placed before.

    labels: the screen, id, anchor (rank of the anchor, best first), x, y, w, h and the order columns.  One screen is one group, as each choice
    bars later ones.
    """
    kind = dict(labels.dtypes)

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = [], []
        for _, some in rows.sort_values([*order, "id"], kind="stable").groupby("id", sort=False):
            for r in some.sort_values("anchor").itertuples():
                box = (r.x - r.w / 2, r.y - r.h / 2, r.x + r.w / 2, r.y + r.h / 2)
                if not any(box[0] < t[2] and t[0] < box[2] and box[1] < t[3] and t[1] < box[3] for t in taken):
                    taken.append(box)
                    out.append((getattr(r, screen), r.id, r.anchor, r.x, r.y))
                    break
        return pd.DataFrame(out, columns=[screen, "id", "anchor", "x", "y"])

    ship(labels.sparkSession)
    return labels.groupBy(screen).applyInPandas(place, f"{screen} {kind[screen]}, id {kind['id']}, anchor {kind['anchor']}, x double, y double")


def review_queue(gaps: DataFrame, ignored: DataFrame, handled: DataFrame, key: str = "gap_id") -> DataFrame:
    """Unresolved gaps that nobody ignored or handled, with the one to look at after each."""
    open_ = gaps.where(F.col("decision").startswith("unresolved")).join(ignored.select(key), key, "left_anti").join(handled.select(key), key, "left_anti")
    w = Window.partitionBy("part").orderBy(key)
    first = F.first(key).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return open_.withColumn("next", F.coalesce(F.lead(key).over(w), first))
