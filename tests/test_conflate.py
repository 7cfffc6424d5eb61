"""The composed matcher on small roads, in metres."""

import math

import pytest
from pyspark.sql import functions as F

from wayfold.plans import conflate, matching


def sampled(spark, *lines):
    """Samples every 5 m of straight reference parts, given by their ends."""
    rows = []
    for part, (x1, y1, x2, y2) in enumerate(lines):
        size = math.dist((x1, y1), (x2, y2))
        tx, ty = (x2 - x1) / size, (y2 - y1) / size
        rows += [(part, k, x1 + tx * 5 * k, y1 + ty * 5 * k, tx, ty) for k in range(int(size // 5) + 1)]
    return spark.createDataFrame(rows, "part long, sample long, x double, y double, tx double, ty double")


def atoms(spark, **lines):
    """Atoms by name: a class and vertices."""
    rows = [(name, c, k, *map(float, a), *map(float, b)) for name, (c, *line) in lines.items() for k, (a, b) in enumerate(zip(line, line[1:], strict=False))]
    return spark.createDataFrame(rows, "edge string, class int, seg int, x1 double, y1 double, x2 double, y2 double")


def by(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows.collect())


def test_a_road_of_two_atoms_is_covered_without_gaps(spark):
    found = conflate.match(sampled(spark, (0, 0, 100, 0)), atoms(spark, a=(1, (0, 3), (50, 3)), b=(1, (50, 3), (100, 3)), cross=(2, (50, -60), (50, 60))))
    assert by(found["coverage"], "part", "covered_pct") == [(0, 100.0)]
    assert by(found["runs"], "owner", "from_m", "to_m") == [("a", 0.0, 50.0), ("b", 50.0, 102.5)]
    assert by(found["gaps"], "owner", "next_owner", "decision") == [("a", "b", "accepted-direct-source-junction")]
    assert by(found["diagnostics"], "edge", "status") == [("a", "accepted-owned-samples"), ("b", "accepted-owned-samples"), ("cross", "rejected-not-near")]
    assert by(found["display"], "chain", "pos", "line", "backwards") == [(0, 0, "a", False), (0, 1, "b", False)]
    assert by(found["report"], "status", "n_atoms") == [("accepted-owned-samples", 2), ("rejected-not-near", 1)]


def test_a_short_piece_between_two_atoms_is_rescued(spark):
    """Two samples are too few for a run; the one atom that touches both neighbours takes them."""
    road = dict(a=(1, (0, 1), (44, 1)), mid=(2, (44, 1), (52, 1)), b=(1, (52, 1), (100, 1)))
    given = sampled(spark, (0, 0, 100, 0))
    cand = matching.candidates(given, atoms(spark, **road))
    assert {r["owner"] for r in matching.own(cand, least=3).collect()} == {"a", "b"}
    owned = spark.createDataFrame([(0, s, "a" if s < 9 else "b", 1) for s in [*range(9), *range(11, 21)]], "part long, sample long, owner string, class int")
    lines = conflate.shapes(atoms(spark, **road))
    rows = conflate._near(owned, given, cand, lines, matching.junctions(conflate.ends(lines)))
    found = conflate._by_part(rows, dict(cand.dtypes), conflate.rescued)
    assert by(found.where("how != 'owned'"), "sample", "owner", "class", "how") == [(9, "mid", 2, "short-straight-through"), (10, "mid", 2, "short-straight-through")]


def test_a_hole_of_one_atom_is_filled_where_it_follows(spark):
    line = [(0.0, 2.0), (100.0, 2.0)]
    owners = {s: "a" for s in range(21) if s not in (8, 9, 10)}
    reference = [(5.0 * k, 0.0) for k in range(21)]
    assert matching.fill_holes(owners, {"a": line}, reference) == dict.fromkeys(range(21), "a")
    away = [(0.0, 2.0), (38.0, 2.0), (45.0, 60.0), (52.0, 2.0), (100.0, 2.0)]
    assert matching.fill_holes(owners, {"a": away}, reference) == owners
    wide = {s: "a" for s in range(21) if not 6 <= s <= 12}
    assert matching.fill_holes(wide, {"a": line}, reference) == wide


@pytest.mark.parametrize(("lo", "hi", "found"), [(2, 5, [(2, 0), (5, 0)]), (2, 13, [(2, 0), (10, 0), (10, 3)]), (12, 20, [(10, 2), (10, 10)])])
def test_stretch(lo, hi, found):
    assert matching.stretch([(0, 0), (10, 0), (10, 10)], lo, hi) == [pytest.approx(p) for p in found]


def test_a_gap_without_a_path_in_its_stretch_stays_open(spark):
    road = dict(a=(1, (0, 0), (60, 0)), way=(1, (60, 0), (80, 80), (100, 0)), b=(1, (100, 0), (160, 0)))
    found = conflate.match(sampled(spark, (0, 0, 160, 0)), atoms(spark, **road), radius=10.0)
    assert by(found["gaps"], "owner", "next_owner", "decision", "geometry_gap_m", "n_paths") == [("a", "b", "unresolved-no-path", 40.0, 0)]
    assert by(found["chosen"], "edge", "status", "length") == [("a", "accepted-owned-samples", 60.0), ("b", "accepted-owned-samples", 60.0)]


def test_a_transition_joins_two_parts(spark):
    road = dict(a=(1, (0, 0), (90, 0)), link=(1, (90, 0), (110, 0)), b=(1, (110, 0), (200, 0)))
    given = sampled(spark, (0, 0, 100, 0), (100, 0, 200, 0))
    lines = conflate.shapes(atoms(spark, **road))
    cand = matching.candidates(given, atoms(spark, **road))
    owned = spark.createDataFrame([(0, s, "a") for s in range(19)] + [(1, s, "b") for s in range(2, 21)], "part long, sample long, owner string")
    assert [(r["part"], r["next_part"], list(r["atoms"])) for r in conflate.transitions(owned, given, cand, lines).collect()] == [(0, 1, ["link"])]


def test_barred_atoms_are_never_taken(spark):
    given, road = sampled(spark, (0, 0, 50, 0)), atoms(spark, a=(1, (0, 1), (50, 1)), twin=(1, (0, 2), (50, 2)))
    found = conflate.match(given, road, barred=spark.createDataFrame([("a",)], "edge string"))
    assert {r["owner"] for r in found["owned"].collect()} == {"twin"}
    none = conflate.match(given, road.where(F.lit(False)))
    assert none["owned"].count() == 0 and by(none["coverage"], "covered_pct") == [(0.0,)]


def test_too_many_classes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(matching, "MAX_CLASSES", 1)
    with pytest.raises(ValueError, match="classes"):
        matching.class_order(spark.createDataFrame([(1,), (2,)], "class int"))


# Rules of the matcher one by one


def test_a_line_follows_only_in_direction_and_near_the_stretch():
    reference = [(5.0 * k, 0.0) for k in range(21)]
    assert matching.follows([(20.0, 3.0), (40.0, 3.0)], reference, 20.0, 40.0) and matching.follows([(40.0, 3.0), (20.0, 3.0)], reference, 20.0, 40.0)
    assert not matching.follows([(28.0, -6.0), (32.0, 6.0)], reference, 25.0, 35.0)  # 72 degrees off
    assert not matching.follows([(20.0, 3.0), (60.0, 3.0)], reference, 20.0, 40.0)  # beyond the stretch
    bend = [(0.0, 0.0), (50.0, 0.0), (50.0, 10.0), (0.0, 10.0)]  # the reference comes back beside itself
    assert not matching.follows([(0.0, 45.0), (50.0, 45.0)], bend, 0.0, 50.0) and matching.follows([(0.0, -5.0), (45.0, -5.0)], bend, 0.0, 50.0)
    assert not matching.follows([(0.0, 0.0)], reference, 0.0, 5.0) and not matching.follows([], reference, 0.0, 5.0)


def test_ends_pair_by_progress_before_turn():
    """A bend of the road goes on into its bend, although a straight line leaves the junction too."""
    ends = [("in", 0, 0, -1.0, 0.0), ("straight", 0, 0, 1.0, 0.0), ("bend", 0, 0, math.cos(0.7), math.sin(0.7))]
    assert matching.pair_ends(ends) == [("in", "straight")]
    progress = {"in": (100.0, 90.0, 0.0), "straight": (100.0, 99.9, 8.0), "bend": (100.0, 110.0, 0.0)}
    assert matching.pair_ends(ends, progress=progress) == [("bend", "in")]
    assert matching.pair_ends([("a", 0, 0, 1.0, 0.0), ("b", 0, 0, 0.0, 1.0)]) == []  # a right angle


def test_chains_move_ends_to_their_mean_and_guards_measure_it(spark):
    road = atoms(spark, a=(1, (0, 0), (49, 1)), b=(1, (50, 0), (100, 0)), c=(1, (101.5, 1), (150, 0)))
    given = sampled(spark, (0, 0, 150, 0))
    lines = conflate.shapes(road)
    owned = spark.createDataFrame([(0, k, e) for k, e in enumerate("abc")], "part long, sample long, owner string")
    shown = conflate.display(owned, lines, given)
    rows = {r.line: r for r in shown.collect()}
    assert {k: (r.chain, r.pos, r.backwards) for k, r in rows.items()} == {"a": (0, 0, False), "b": (0, 1, False), "c": (0, 2, False)}
    assert [(p.x, p.y) for p in rows["a"].path] == [(0, 0), (49.5, 0.5)] and [(p.x, p.y) for p in rows["b"].path] == [(49.5, 0.5), (100.75, 0.5)]
    (found,) = conflate.guards(shown, lines, given).collect()
    assert found.kept and math.isclose(found.moved_m, math.hypot(0.75, 0.5), rel_tol=1e-6) and math.isclose(found.source_residual_m, 1.0) and math.isclose(found.display_residual_m, 0.5)
    away = shown.withColumn("path", F.transform("path", lambda p: F.struct(p["x"].alias("x"), (p["y"] + 9).alias("y"))))
    (found,) = conflate.guards(away, lines, given).collect()
    assert not found.kept and found.moved_m > 8


def gap_of(spark, road, given=None, **limits):
    """The decision about the gap between atoms a (0 to 60) and b (100 to 160) of one straight part."""
    given = given or sampled(spark, (0, 0, 160, 0))
    rows = atoms(spark, a=(1, (0, 0), (60, 0)), b=(1, (100, 0), (160, 0)), **road)
    lines = conflate.shapes(rows)
    segs = conflate.polyline.line_segments(lines, "edge")
    runs = spark.createDataFrame([(0, 1, "a", 1, 0, 13, 0.0, 60.0), (0, 2, "b", 1, 20, 33, 100.0, 160.0)], "part long, run int, owner string, class int, start long, end long, from_m double, to_m double")
    ranges = conflate.source_ranges(runs, given, segs)
    assert sorted((r.owner, round(r.lo, 6), round(r.hi, 6)) for r in ranges.collect()) == [("a", 0, 60), ("b", 0, 60)]
    met = conflate.meeting_places(matching.junctions(conflate.ends(lines)), conflate.ends(lines), given, 35.0, 5.0)
    gaps = conflate.decide(runs, ranges, segs, met)
    (gap,) = gaps.collect()
    assert gap.gap_m == 40 and gap.geometry_gap_m == 40 and gap.decision == "open"
    kinds = rows.select("edge", "class").distinct()
    taken = spark.createDataFrame([("a",), ("b",)], "edge string")
    (found,) = conflate.connectors(gaps, conflate.topology.junctions(lines, "edge", 2.0), conflate.spans(given, segs, kinds), taken, kinds, **limits).collect()
    return found.decision, found.path, [(list(p.path), list(p.reasons)) for p in found.paths or []]


@pytest.mark.parametrize(
    ("road", "want"),
    [
        ({"way": (1, (60, 0), (80, 5), (100, 0))}, ("accepted-auto-connector", ["way"], [(["way"], [])])),
        ({"way": (1, (60, 0), (80, 5), (80, 0)), "on": (1, (80, 0), (100, 0))}, ("accepted-auto-connector", ["way", "on"], [(["way", "on"], [])])),
        ({"way": (1, (60, 0), (80, 5), (100, 0)), "twin": (1, (60, 0), (80, -5), (100, 0))}, ("unresolved-ambiguous", None, [(["twin"], []), (["way"], [])])),
        ({"way": (2, (60, 0), (80, 5), (100, 0))}, ("unresolved-no-path", None, [])),  # of another class
        ({"way": (1, (60, 0), (70, 35), (80, -35), (90, 35), (100, 0))}, ("unresolved-threshold", None, [(["way"], ["detour-ratio", "insufficient-progression"])])),
        ({"stem": (1, (60, 0), (80, 30))}, ("unresolved-no-path", None, [])),
        ({"loop": (1, (60, 0), (40, 5), (20, 0))}, ("unresolved-no-path", None, [])),  # outside the stretch
    ],
)
def test_connectors_by_class_window_progress_and_number(spark, road, want):
    assert gap_of(spark, road) == want


def test_an_inside_junction_opens_a_path(spark):
    """The connector starts on the inside of an atom, not at its end."""
    assert gap_of(spark, {"way": (1, (58.5, 1.5), (80, 5), (100, 0))})[0] == "accepted-auto-connector"


def test_what_is_chosen_has_geometry(spark):
    road = dict(a=(1, (0, 0), (90, 0)), link=(1, (90, 0), (110, 0)), b=(1, (110, 0), (200, 0)), spur=(2, (50, 0), (50, 90)))
    found = conflate.match(sampled(spark, (0, 0, 100, 0), (100, 0, 200, 0)), atoms(spark, **road))
    rows = {(r.part, r.edge): (r.status, [(round(p.x, 6), round(p.y, 6)) for p in r.line], round(r.length, 6)) for r in found["chosen"].collect()}
    assert rows[(0, "a")] == ("accepted-owned-samples", [(0, 0), (90, 0)], 90.0)
    assert all(r.kept for r in found["guards"].collect())
    assert rows[(1, "link")][2] == 10 and "spur" not in {e for _, e in rows}  # the other half of the link is too short for a run
