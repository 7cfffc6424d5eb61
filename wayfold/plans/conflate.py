"""The whole matcher: from samples of reference parts and source atoms to owned runs, decided gaps, diagnostics and display chains.

Distributed steps (candidates, suppression across parts, healing, runs, gaps, connectors, diagnostics) are joins and windows.  Steps that
depend on their own earlier choices (hand-offs, hole and straight-through rescue, transitions, chains) run as plain functions over one
part at a time, on what lies near its own line.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.model import LINE
from wayfold.operators import grid, polyline, topology
from wayfold.operators.components import cut
from wayfold.plans import kernels, matching
from wayfold.plans.matching import RADIUS, SNAP, STEP
from wayfold.session import ship

#: Samples of a part's end that tell its direction: arms of 25 m.
ARM = 5


def shapes(atoms: DataFrame) -> DataFrame:
    """edge, line: the vertices of each atom in order.  atoms: edge, seg, x1, y1, x2, y2."""
    rows = F.sort_array(F.collect_list(F.struct("seg", "x1", "y1", "x2", "y2")))
    first = F.transform(F.slice(rows, 1, 1), lambda s: F.struct(s["x1"].alias("x"), s["y1"].alias("y")))
    return atoms.groupBy("edge").agg(F.concat(first, F.transform(rows, lambda s: F.struct(s["x2"].alias("x"), s["y2"].alias("y")))).alias("line"))


def ends(lines: DataFrame) -> DataFrame:
    """edge, x, y: both ends of each line."""
    both = F.array(F.element_at("line", 1), F.element_at("line", -1))
    return lines.select("edge", F.explode(both).alias("p")).select("edge", "p.x", "p.y")


def _near(owned: DataFrame, samples: DataFrame, cand: DataFrame, lines: DataFrame, touch: DataFrame) -> DataFrame:
    """A row a part with its owners, samples, candidates, their lines and which of them touch."""
    edges = cand.select("part", "edge").distinct()
    near = cand.groupBy("part").agg(F.collect_list(F.struct("sample", "edge", "class", "cost")).alias("near"))
    have = owned.groupBy("part").agg(F.collect_list(F.struct("sample", "owner")).alias("have"))
    ref = samples.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("sample", "x", "y"))).alias("ref"))
    of = edges.join(lines, "edge").groupBy("part").agg(F.collect_list(F.struct("edge", "line")).alias("lines"))
    pairs = edges.withColumnRenamed("edge", "a").join(touch, "a").join(edges.withColumnRenamed("edge", "b"), ["part", "b"]).groupBy("part").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    return near.join(have, "part").join(ref, "part").join(of, "part").join(pairs, "part", "left")


def _by_part(rows: DataFrame, kind: dict[str, str], step: Callable[[dict], tuple[dict[int, object], dict[int, str]]]) -> DataFrame:
    """part, sample, owner, class, how: what a step over one part gives, and by which rule a sample got its owner."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part in frame.to_dict("records"):
                cand: dict[int, list[tuple[float, object]]] = {}
                rank = {}
                for c in part["near"]:
                    cand.setdefault(int(c["sample"]), []).append((float(c["cost"]), c["edge"]))
                    rank[c["edge"]] = int(c["class"])
                touch = {(p["a"], p["b"]) for p in (part["pairs"] if part["pairs"] is not None else ())}
                facts = {
                    "owners": {int(r["sample"]): r["owner"] for r in part["have"]},
                    "candidates": cand,
                    "rank": rank,
                    "touches": lambda a, b, touch=touch: (a, b) in touch or (b, a) in touch,
                    "lines": {r["edge"]: [(p["x"], p["y"]) for p in r["line"]] for r in part["lines"]},
                    "reference": [(r["x"], r["y"]) for r in part["ref"]],
                }
                owners, how = step(facts)
                out += [(part["part"], s, owners[s], rank[owners[s]], how.get(s, "owned")) for s in sorted(owners)]
            yield pd.DataFrame(out, columns=["part", "sample", "owner", "class", "how"])

    ship(rows.sparkSession)
    return rows.mapInPandas(run, f"part {kind['part']}, sample long, owner {kind['edge']}, class int, how string")


def handed_off(facts: dict) -> tuple[dict[int, object], dict[int, str]]:
    found = kernels.validate_handoffs(facts["owners"], facts["rank"], facts["candidates"], facts["touches"])
    return found, {s: "handed-off" for s, e in found.items() if facts["owners"][s] != e}


def rescued(facts: dict) -> tuple[dict[int, object], dict[int, str]]:
    """Holes of one atom first, then straight-through holes."""
    filled = matching.fill_holes(facts["owners"], facts["lines"], facts["reference"])
    whole = matching.rescue(filled, facts["lines"], facts["reference"])
    how = {s: "same-source-hole" for s in filled if s not in facts["owners"]} | {s: "short-straight-through" for s in whole if s not in filled}
    return whole, how


def transitions(owned: DataFrame, samples: DataFrame, cand: DataFrame, lines: DataFrame, snap: float = SNAP) -> DataFrame:
    """part, next_part, atoms: the atoms that carry the match over where one part ends and another starts, if just one choice does."""
    w = Window.partitionBy("part")
    at = samples.withColumn("n", F.max("sample").over(w)).join(owned.select("part", "sample", "owner"), ["part", "sample"], "left")
    point = F.struct("sample", "x", "y", "tx", "ty")
    facts = at.groupBy("part").agg(
        F.max("n").alias("n"),
        F.min_by(point, "sample").alias("first"),
        F.max_by(point, "sample").alias("last"),
        F.min(F.when(F.col("owner").isNotNull(), F.struct("sample", "owner"))).alias("start"),
        F.max(F.when(F.col("owner").isNotNull(), F.struct("sample", "owner"))).alias("end"),
        F.sort_array(F.collect_list(F.when(F.col("sample") >= F.col("n") - ARM, F.struct("sample", "x", "y")))).alias("tail"),
        F.sort_array(F.collect_list(F.when(F.col("sample") <= ARM, F.struct("sample", "x", "y")))).alias("head"),
    )
    one = facts.where("end is not null").select("part", F.col("last.x").alias("x"), F.col("last.y").alias("y"), F.col("end.owner").alias("end_owner"), (F.col("n") - F.col("end.sample")).alias("end_gap"), "tail")
    two = facts.where("start is not null").select(F.col("part").alias("next_part"), F.col("first.x").alias("ox"), F.col("first.y").alias("oy"), F.col("start.owner").alias("start_owner"), F.col("start.sample").alias("start_gap"), "head")
    pairs = grid.grid_distance_join(one, two, snap).where("part != next_part").select("part", "next_part", "end_owner", "end_gap", "tail", "start_owner", "start_gap", "head")
    limit = samples.groupBy("part").agg((F.max("sample") - ARM).alias("from"))
    close = cand.join(limit, "part").where((F.col("sample") >= F.col("from")) | (F.col("sample") <= ARM)).select("part", "edge").distinct()
    both = pairs.select("part", "next_part", F.explode(F.array("part", "next_part")).alias("of")).join(close.withColumnRenamed("part", "of"), "of").select("part", "next_part", "edge")
    named = both.union(pairs.select("part", "next_part", F.explode(F.array("end_owner", "start_owner")).alias("edge"))).distinct()
    near = named.join(lines, "edge").groupBy("part", "next_part").agg(F.collect_list(F.struct("edge", "line")).alias("lines"))
    kind = dict(pairs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                tail, head = ([(p["x"], p["y"]) for p in r[k]] for k in ("tail", "head"))
                if len(tail) < 2 or len(head) < 2:
                    continue
                arms = [(line[-1][0] - line[0][0], line[-1][1] - line[0][1]) for line in (tail, head)]
                of = {x["edge"]: [(p["x"], p["y"]) for p in x["line"]] for x in r["lines"]}
                reference = tail + [p for p in head if math.dist(p, tail[-1]) > 1e-9]
                found = kernels.part_transition(r["end_owner"], int(r["end_gap"]), arms[0], r["start_owner"], int(r["start_gap"]), arms[1], of, reference, {r["end_owner"], r["start_owner"]})
                if found is not None:
                    out.append((r["part"], r["next_part"], list(found)))
            yield pd.DataFrame(out, columns=["part", "next_part", "atoms"])

    ship(samples.sparkSession)
    return pairs.join(near, ["part", "next_part"]).mapInPandas(run, f"part {kind['part']}, next_part {kind['part']}, atoms array<{kind['end_owner']}>")


def meeting_places(touch: DataFrame, points: DataFrame, samples: DataFrame, radius: float, step: float, snap: float = SNAP) -> DataFrame:
    """part, a, b, at_m: where on a part two atoms meet, from the sample nearest to their common end."""
    a = touch.join(points.select(F.col("edge").alias("a"), "x", "y"), "a")
    b = points.select(F.col("edge").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    met = a.join(b, "b").where(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= snap).select("a", "b", "x", "y")
    other = samples.select("part", "sample", F.col("x").alias("ox"), F.col("y").alias("oy"), "tx", "ty")
    near = grid.grid_distance_join(met, other, radius)
    along = (F.col("x") - F.col("ox")) * F.col("tx") + (F.col("y") - F.col("oy")) * F.col("ty")
    return near.groupBy("part", "a", "b").agg(F.min_by(F.greatest(F.lit(0.0), F.col("sample") * step + F.greatest(F.lit(-step), F.least(F.lit(step), along))), F.struct("distance", "sample")).alias("at_m"))


def diagnostics(owned: DataFrame, atoms: DataFrame, cand: DataFrame, carried: DataFrame) -> DataFrame:
    """Every atom with its status: by which rule it was taken, or that it owns no run, and how many samples it owns."""
    status = F.when(F.max(F.col("how") == "owned"), "accepted-owned-samples").when(F.max(F.col("how") == "short-straight-through"), "accepted-short-straight-through").otherwise("accepted-owned-samples")
    taken = owned.groupBy(F.col("owner").alias("edge")).agg(F.count("*").alias("n_samples"), status.alias("status"))
    over = carried.select(F.explode("atoms").alias("edge")).distinct().withColumn("over", F.lit("accepted-reference-part-transition"))
    every = atoms.select("edge", "class").distinct().join(cand.select("edge").distinct().withColumn("near", F.lit(True)), "edge", "left")
    joined = every.join(taken, "edge", "left").join(over, "edge", "left")
    reason = F.coalesce("over", "status", F.when(F.col("near"), "rejected-no-owned-run").otherwise("rejected-not-near"))
    return joined.select("edge", "class", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), reason.alias("status"))


def report(found: DataFrame) -> DataFrame:
    """How many atoms and owned samples each status has."""
    return found.groupBy("status").agg(F.count("*").alias("n_atoms"), F.sum("n_samples").alias("n_samples"))


def display(owned: DataFrame, lines: DataFrame, samples: DataFrame, snap: float = SNAP) -> DataFrame:
    """part, chain, pos, line, backwards, path: the taken atoms of each part, joined through their paired ends.  path has the atom's vertices in the chain's
    direction, its ends moved to where they meet.
    """
    kinds = dict(owned.dtypes)
    taken = owned.select("part", F.col("owner").alias("edge")).distinct().join(lines, "edge")
    ref = samples.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("sample", "x", "y"))).alias("ref"))
    whole = taken.groupBy("part").agg(F.collect_list(F.struct(F.col("edge").alias("line"), F.col("line").alias("points"))).alias("lines")).join(ref, "part")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame.to_dict("records"):
                flat = pd.DataFrame([(r["line"], i, p["x"], p["y"]) for r in part["lines"] for i, p in enumerate(r["points"])], columns=["line", "i", "x", "y"])
                out = matching.chains(flat, snap, reference=[(p["x"], p["y"]) for p in part["ref"]])
                out.insert(0, "part", part["part"])
                yield out

    ship(owned.sparkSession)
    return whole.mapInPandas(run, f"part {kinds['part']}, chain long, pos long, line {kinds['owner']}, backwards boolean, path {LINE}")


def part_segments(samples: DataFrame) -> DataFrame:
    """The reference parts as segments with running lengths."""
    return polyline.segments(samples.select("part", "sample", "x", "y"), "part", ["sample"])


def guards(shown: DataFrame, lines: DataFrame, samples: DataFrame, snap: float = SNAP, step: float = STEP) -> DataFrame:
    """part, moved_m, source_residual_m, display_residual_m, kept: how far display chains are from their atoms, how far both are from the reference, and
    whether neither is more than the tolerance allows.
    """
    both = shown.select("part", F.struct("part", "line").alias("k"), "line", "path").join(lines.select(F.col("edge").alias("line"), F.col("line").alias("points")), "line")
    moved = both.groupBy("part").agg(F.max(g.hausdorff(F.col("path"), F.col("points"))).alias("moved_m"))
    reference = cut(part_segments(samples).select("x1", "y1", "x2", "y2"))

    def residual(column: str, into: str) -> DataFrame:
        spots = polyline.samples(polyline.line_segments(both.select("k", column), "k", column), "k", step).select("k", "sample", "at", "x", "y")
        return grid.nearest_distance(spots, reference, ["k", "sample", "at"], RADIUS).groupBy(F.col("k.part").alias("part")).agg(F.max("distance").alias(into))

    found = moved.join(residual("points", "source_residual_m"), "part", "left").join(residual("path", "display_residual_m"), "part", "left")
    slack = snap + 1e-6
    return found.withColumn("kept", (F.col("moved_m") <= slack) & (F.coalesce("display_residual_m", F.lit(0.0)) <= F.coalesce("source_residual_m", F.lit(0.0)) + slack))


def source_ranges(runs: DataFrame, samples: DataFrame, segs: DataFrame) -> DataFrame:
    """part, run, owner, lo, hi: where on its atom each run starts and ends, by the places on the atom that are nearest to the run's ends."""
    both = runs.select("part", "run", "owner", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("from_m").alias("at")), F.struct(F.lit(1).alias("end"), F.col("to_m").alias("at")))).alias("e")).select("part", "run", "owner", "e.end", "e.at")
    spots = polyline.points_at(both, part_segments(samples), "part", "at", ["run", "owner", "end"])
    corners = tuple(map(F.col, ("px", "py", "x1", "y1", "x2", "y2")))
    met = spots.join(segs.withColumnRenamed("edge", "owner"), "owner")
    at = F.col("from") + g.along(*corners) * (F.col("to") - F.col("from"))
    near = met.groupBy("part", "run", "owner", "end").agg(F.min_by(at, F.struct(g.point_segment(*corners), F.col("seg"))).alias("at"))
    return near.groupBy("part", "run", "owner").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))


#: Published limits of connectors: least progress along the reference, metres around the gap, metres beside it.
PROGRESS, WINDOW, CORRIDOR = 0.35, 10.0, RADIUS + 5.0


def spans(samples: DataFrame, segs: DataFrame, kinds: DataFrame) -> DataFrame:
    """part, edge, class, length, first_m, mid_m, last_m, low_m, high_m: where on a part an atom's ends, middle and vertices are.

    Only atoms that have every vertex within twice the corridor of the part, which is what a connector needs.
    """
    vertices = segs.select("edge", "seg", F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(segs.groupBy("edge").agg(F.max_by(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")), "seg").alias("p"), (F.max("seg") + 1).alias("seg")).select("edge", "seg", "p.x", "p.y"))
    sizes = segs.groupBy("edge").agg(F.max("to").alias("length"), (F.max("seg") + 2).alias("n"))
    middle = polyline.points_at(sizes.select("edge", (F.col("length") / 2).alias("at")), segs, "edge", "at", []).select("edge", F.lit(-1).alias("seg"), F.col("px").alias("x"), F.col("py").alias("y"))
    ref = part_segments(samples).select("part", F.col("seg").alias("rseg"), "x1", "y1", "x2", "y2", "from", "to")
    corners = tuple(map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    near = grid.grid_segment_join(vertices.unionByName(middle), ref, 2 * CORRIDOR, g.point_segment(*corners))
    at = F.col("from") + g.along(*corners) * (F.col("to") - F.col("from"))
    placed = near.groupBy("part", "edge", "seg").agg(F.min_by(at, F.struct("distance", "rseg")).alias("m"), F.min("distance").alias("d"))
    real = F.col("seg") >= 0
    whole = placed.groupBy("part", "edge").agg(F.count_if(real).alias("found"), F.min("d").alias("d"), F.min(F.when(real, F.struct("seg", "m"))).alias("a"), F.max(F.when(real, F.struct("seg", "m"))).alias("b"), F.max(F.when(~real, F.col("m"))).alias("mid_m"), F.min(F.when(real, F.col("m"))).alias("low_m"), F.max(F.when(real, F.col("m"))).alias("high_m"))
    return whole.join(sizes, "edge").where((F.col("found") == F.col("n")) & (F.col("d") <= CORRIDOR)).join(kinds, "edge").select("part", "edge", "class", "length", F.col("a.m").alias("first_m"), "mid_m", F.col("b.m").alias("last_m"), "low_m", "high_m")


def connectors(open_gaps: DataFrame, places: DataFrame, around: DataFrame, taken: DataFrame, kinds: DataFrame, snap: float = SNAP, max_length: float = matching.MAX_GAP, max_detour: float = matching.MAX_DETOUR) -> DataFrame:
    """The gaps with ``decision``, ``path`` (the atoms of the one path that fits), ``n_paths`` and ``paths`` (each with length, detour, progress and why it does not fit).

    open_gaps: part, run, owner, next_owner, to_m, next_from, gap_m, geometry_gap_m.  places: a, b, at_a, at_b of source junctions.  around: ``spans``.
    A path has one or two atoms that own nothing, of the classes of both sides, within ``WINDOW`` of the gap's stretch.  It must be left elsewhere than it
    was entered, be short enough in all and against the gap, not go back along the reference, and progress on it with every atom.  More than one that
    fits leaves the gap ambiguous; there is never a best guess.
    """
    both = places.select("a", "b", F.struct(F.col("at_a").alias("out"), F.col("at_b").alias("in")).alias("j")).unionByName(places.select(F.col("b").alias("a"), F.col("a").alias("b"), F.struct(F.col("at_b").alias("out"), F.col("at_a").alias("in")).alias("j")))
    doors = both.groupBy("a", "b").agg(F.collect_set("j").alias("doors"))  # a handful a pair
    keys = ["part", "run"]
    side = lambda c, name: kinds.select(F.col("edge").alias(c), F.col("class").alias(name))
    asked = open_gaps.join(side("owner", "_c1"), "owner").join(side("next_owner", "_c2"), "next_owner")
    inside = (F.col("low_m") >= F.col("to_m") - WINDOW) & (F.col("high_m") <= F.col("next_from") + WINDOW) & ((F.col("class") == F.col("_c1")) | (F.col("class") == F.col("_c2")))
    pool = asked.join(around, "part").where(inside).join(taken.select("edge"), "edge", "left_anti").select(*keys, "owner", "next_owner", F.struct("edge", "length", "first_m", "mid_m", "last_m").alias("atom"))
    apart = lambda ins, outs: F.exists(ins, lambda i: F.exists(outs, lambda o: F.abs(i["in"] - o["out"]) > snap))
    into = doors.select(F.col("a").alias("owner"), F.col("b").alias("_b"), F.col("doors").alias("ins"))
    out = doors.select(F.col("a").alias("_a"), F.col("b").alias("next_owner"), F.col("doors").alias("outs"))
    entered = pool.join(into, "owner").where(F.col("atom.edge") == F.col("_b")).drop("_b")
    left = pool.join(out, "next_owner").where(F.col("atom.edge") == F.col("_a")).drop("_a")
    one = entered.join(left.select(*keys, F.col("atom.edge").alias("_e"), "outs"), keys).where((F.col("atom.edge") == F.col("_e")) & apart(F.col("ins"), F.col("outs"))).select(*keys, F.array("atom").alias("atoms"))
    links = doors.where(F.size("doors") == 1).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "doors")
    first = entered.select(*keys, F.col("atom").alias("one"), "ins").join(links, F.col("one.edge") == F.col("_a"))
    two = first.join(left.select(*keys, F.col("atom").alias("two"), "outs"), keys).where((F.col("two.edge") == F.col("_b")) & (F.col("one.edge") != F.col("two.edge")) & apart(F.col("ins"), F.col("doors")) & apart(F.col("doors"), F.col("outs"))).select(*keys, F.array("one", "two").alias("atoms"))
    found = one.unionByName(two).join(open_gaps.select(*keys, "gap_m", "geometry_gap_m"), keys)
    total = F.aggregate("atoms", F.lit(0.0), lambda t, a: t + a["length"])
    gone = lambda a: F.abs(a["last_m"] - a["first_m"])
    rated = found.withColumn("length", total).withColumn("detour", F.col("length") / F.greatest("gap_m", "geometry_gap_m", F.lit(1.0))).withColumn("progress", F.aggregate("atoms", F.lit(0.0), lambda t, a: t + gone(a)) / F.greatest("length", F.lit(1.0)))
    back = (F.size("atoms") == 2) & (F.element_at("atoms", -1)["mid_m"] + WINDOW < F.element_at("atoms", 1)["mid_m"])
    slow = (F.col("progress") < PROGRESS) | F.exists("atoms", lambda a: gone(a) / F.greatest(a["length"], F.lit(1.0)) < PROGRESS)
    why = F.array_compact(F.array(F.when(F.col("length") > max_length, "maximum-length"), F.when(F.col("detour") > max_detour, "detour-ratio"), F.when(back, "non-monotonic-progression"), F.when(slow, "insufficient-progression")))
    path = F.struct(F.transform("atoms", lambda a: a["edge"]).alias("path"), F.round("length", 3).alias("length"), F.round("detour", 3).alias("detour"), F.round("progress", 3).alias("progress"), why.alias("reasons"))
    listed = rated.groupBy(*keys).agg(F.array_sort(F.collect_list(path)).alias("paths"))
    joined = open_gaps.join(listed, keys, "left")
    fit = F.filter("paths", lambda p: F.size(p["reasons"]) == 0)
    decision = F.when(F.size(fit) == 1, "accepted-auto-connector").when(F.size(fit) > 1, "unresolved-ambiguous").when(F.size("paths") > 0, "unresolved-threshold").otherwise("unresolved-no-path")
    return joined.withColumn("decision", decision).withColumn("path", F.when(F.size(fit) == 1, F.get(fit, F.lit(0))["path"])).withColumn("n_paths", F.coalesce(F.when(F.size("paths") > 0, F.size("paths")), F.lit(0)).cast("long"))


def decide(runs: DataFrame, ranges: DataFrame, segs: DataFrame, met: DataFrame, step: float = STEP, snap: float = SNAP) -> DataFrame:
    """Gaps between consecutive runs with what is decided without a search: a stretch of one atom, too long, or the two atoms meet within the gap.

    ``geometry_gap_m`` is the distance between the ends of the two runs' stretches of source line.
    """
    gaps = matching.gaps(runs, step).drop("decision")
    order = Window.partitionBy("part").orderBy(F.col("from_m") + F.col("to_m"), "run")
    following = runs.select("part", "run", F.lead("run").over(order).alias("next_run"))
    ends = ranges.select("part", "run", "owner", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("at")))).alias("e")).select("part", "run", F.col("owner").alias("edge"), "e.end", "e.at")
    spots = polyline.points_at(ends, segs, "edge", "at", ["part", "run", "end"])
    pts = spots.groupBy("part", "run").agg(F.collect_list(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).alias("tips"))  # two
    nexts = pts.select("part", F.col("run").alias("next_run"), F.col("tips").alias("next_tips"))
    held = ranges.select("part", "run", "lo", "hi")
    later = ranges.select("part", F.col("run").alias("next_run"), F.col("lo").alias("next_lo"), F.col("hi").alias("next_hi"))
    wide = gaps.join(following, ["part", "run"]).join(pts, ["part", "run"], "left").join(nexts, ["part", "next_run"], "left").join(held, ["part", "run"], "left").join(later, ["part", "next_run"], "left")
    near = F.array_min(F.flatten(F.transform("tips", lambda p: F.transform("next_tips", lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))))
    both = met.select("part", F.col("a").alias("owner"), F.col("b").alias("next_owner"), "at_m").unionByName(met.select("part", F.col("b").alias("owner"), F.col("a").alias("next_owner"), "at_m"))
    direct = wide.select("part", "run", "owner", "next_owner", "to_m", "next_from").join(both, ["part", "owner", "next_owner"]).where(F.col("at_m").between(F.col("to_m") - snap, F.col("next_from") + snap)).select("part", "run").distinct().withColumn("direct", F.lit(True))
    source_gap = F.greatest(F.lit(0.0), F.greatest("lo", "next_lo") - F.least("hi", "next_hi"))
    same = (F.col("owner") == F.col("next_owner")) & (source_gap <= matching.MAX_GAP) & (source_gap / F.greatest("gap_m", F.lit(1.0)) <= matching.MAX_DETOUR)
    decision = F.when(F.col("gap_m") > matching.MAX_GAP, "unresolved-gap-too-long").when(same, "accepted-same-source-range").when((F.col("gap_m") <= 1e-9) | F.col("direct"), "accepted-direct-source-junction").otherwise("open")
    return wide.join(direct, ["part", "run"], "left").withColumn("geometry_gap_m", F.coalesce(near, F.lit(0.0))).withColumn("decision", decision).select("part", "run", "owner", "next_owner", "to_m", "next_from", "gap_m", "geometry_gap_m", "decision")


def chosen(ranges: DataFrame, segs: DataFrame, carried: DataFrame, decided: DataFrame) -> DataFrame:
    """part, edge, status, line, length: the geometry that the match takes.  Runs give their stretch of the atom; atoms that carry the match over from part
    to part, and those of connectors, come whole, once a part.
    """
    owned = polyline.substrings(segs, ranges.select(F.col("owner").alias("edge"), "part", "run", "lo", "hi"), "edge", ["part", "run"]).select("part", "edge", F.lit("accepted-owned-samples").alias("status"), "line", "length")
    over = carried.select("part", F.explode("atoms").alias("edge"), F.lit("accepted-reference-part-transition").alias("status"))
    bridge = decided.where("path is not null").select("part", F.explode("path").alias("edge"), F.lit("accepted-continuity-connector").alias("status"))
    sizes = segs.groupBy("edge").agg(F.lit(0.0).alias("lo"), F.max("to").alias("hi"))
    extra = over.unionByName(bridge).groupBy("part", "edge").agg(F.min("status").alias("status")).join(owned.select("part", "edge").distinct(), ["part", "edge"], "left_anti")
    whole = polyline.substrings(segs, extra.join(sizes, "edge"), "edge", ["part", "status"]).select("part", "edge", "status", "line", "length")
    return owned.unionByName(whole)


def match(samples: DataFrame, atoms: DataFrame, step: float = STEP, radius: float = RADIUS, suppression: float = matching.PARALLEL_RADIUS, snap: float = SNAP, barred: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every step in order.  samples: part, sample, x, y, tx, ty, a row a sample.  atoms: edge, class, seg, x1, y1, x2, y2, a row a segment.

    ``barred`` (edge) is never taken.  Gives owned samples with the rule that gave them, runs drawn out to junctions, decided gaps, transitions between
    parts, the chosen source geometry, coverage, diagnostics, their report, display chains and their guards.
    """
    if barred is not None:
        atoms = atoms.join(barred.select("edge"), "edge", "left_anti")
    lines = cut(shapes(atoms))
    points = ends(lines)
    touch = cut(matching.junctions(points, snap))
    cand = cut(matching.candidates(samples, atoms, radius))
    kind = dict(cand.dtypes)
    classes = matching.class_order(atoms)
    kinds = atoms.select("edge", "class").distinct()
    segs = cut(polyline.line_segments(lines, "edge"))
    first = matching.own(cand, matching.BONUS, matching.LEAST_RUN, classes)
    joined = cut(_by_part(_near(first, samples, cand, lines, touch), kind, handed_off))
    healed = matching.heal(matching.suppress(joined, samples, suppression), samples)
    owned = cut(_by_part(_near(healed, samples, cand, lines, touch), kind, rescued))
    carried = cut(transitions(owned, samples, cand, lines, snap))
    met = cut(meeting_places(touch, points, samples, radius, step, snap))
    runs = cut(kernels.extend_to_junctions(matching.owned_runs(owned, step), met))
    ranges = cut(source_ranges(runs, samples, segs))
    gaps = cut(decide(runs, ranges, segs, met, step, snap))
    open_gaps = gaps.where("decision = 'open'")
    decided = gaps.where("decision != 'open'")
    if open_gaps.isEmpty():  # nothing to search for
        known = dict(cand.dtypes)["edge"]
        path = f"array<struct<path: array<{known}>, length: double, detour: double, progress: double, reasons: array<string>>>"
        decided = decided.withColumn("paths", F.lit(None).cast(path)).withColumn("path", F.lit(None).cast(f"array<{known}>")).withColumn("n_paths", F.lit(None).cast("long"))
    else:
        taken = owned.select(F.col("owner").alias("edge")).distinct()
        tried = connectors(open_gaps, topology.junctions(lines, "edge", snap), cut(spans(samples, segs, kinds)), taken, kinds, snap)
        decided = cut(tried.unionByName(decided, allowMissingColumns=True))
    status = diagnostics(owned, atoms, cand, carried)
    shown = cut(display(owned, lines, samples, snap))
    return {
        "owned": owned,
        "runs": runs,
        "gaps": decided,
        "transitions": carried,
        "chosen": chosen(ranges, segs, carried, decided),
        "coverage": matching.coverage(samples, owned),
        "diagnostics": status,
        "report": report(status),
        "display": shown,
        "guards": guards(shown, lines, samples, snap, step),
    }
