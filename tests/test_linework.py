"""Lines and polygons: parts, contacts, clips and unions against plain Python or sampling."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from wayfold.functions import clouds, polygons, style, wkb
from wayfold.functions import geometry as g
from wayfold.model import GEOMETRY, LINE
from wayfold.operators import clip, labels, noding, polyline, topology


def lines(spark, rows):
    return spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in rows.items()], f"id string, line {LINE}")


def xy(line):
    return [(round(p.x, 9), round(p.y, 9)) for p in line]


# Parts of lines


def test_substrings_add_up_and_keep_vertices(spark):
    r = random.Random(2)
    shapes = {f"l{k}": [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(r.randint(2, 12))] for k in range(20)}
    segs = polyline.line_segments(lines(spark, shapes), "id")
    size = {k: sum(map(math.dist, v, v[1:])) for k, v in shapes.items()}
    cuts = [(k, i, size[k] * i / 5, size[k] * (i + 1) / 5) for k in shapes for i in range(5)]
    found = polyline.substrings(segs, spark.createDataFrame(cuts, "id string, n int, lo double, hi double"), "id", ["n"]).collect()
    assert len(found) == len(cuts)
    for k, v in shapes.items():
        mine = sorted((f for f in found if f.id == k), key=lambda f: f.n)
        assert math.isclose(sum(f.length for f in mine), size[k])
        joined = xy(mine[0].line) + [p for f in mine[1:] for p in xy(f.line)[1:]]
        assert [p for p in joined if p in {(round(x, 9), round(y, 9)) for x, y in v}] == [(round(x, 9), round(y, 9)) for x, y in v]


def test_substring_bounds(spark):
    segs = polyline.line_segments(lines(spark, {"a": [(0, 0), (10, 0), (10, 0), (10, 10)]}), "id")
    cuts = spark.createDataFrame([("a", 1, -5.0, 4.0), ("a", 2, 18.0, 99.0), ("a", 3, 12.0, 8.0), ("a", 4, 5.0, 5.0), ("a", 5, 10.0, 20.0), ("a", 6, None, 3.0)], "id string, n int, lo double, hi double")
    found = {f.n: xy(f.line) for f in polyline.substrings(segs, cuts, "id", ["n"]).collect()}
    assert found == {1: [(0, 0), (4, 0)], 2: [(10, 8), (10, 10)], 3: [(8, 0), (10, 0), (10, 2)], 5: [(10, 0), (10, 10)]}


def test_prefix_over_parts(spark):
    rows = spark.createDataFrame([("a", 0, [(0.0, 0.0), (10.0, 0.0)]), ("a", 1, [(20.0, 0.0), (30.0, 0.0)]), ("a", 2, [(50.0, 0.0), (90.0, 0.0)])], f"id string, part int, line {LINE}")
    segs = polyline.line_segments(rows, "id", part="part")
    at = lambda share: {f.part: xy(f.line) for f in polyline.prefixes(segs, "id", share, "part").collect()}
    assert at(0.25) == {0: [(0, 0), (10, 0)], 1: [(20, 0), (25, 0)]}
    assert at(0.0) == {} and at(2.0)[2] == [(50, 0), (90, 0)]


def test_points_at(spark):
    segs = polyline.line_segments(lines(spark, {"a": [(0, 0), (3, 0), (3, 4)]}), "id")
    places = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([-1, 0, 1.5, 3, 5, 7, 9])], "id string, n int, at double")
    found = {r.n: (r.px, r.py) for r in polyline.points_at(places, segs, "id", "at", ["n"]).collect()}
    assert found == {0: (0, 0), 1: (0, 0), 2: (1.5, 0), 3: (3, 0), 4: (3, 2), 5: (3, 4), 6: (3, 4)}


# Adjacency

CASES = {
    "coincident ends": ([(0, 0), (10, 0)], [(10, 0), (20, 1)], True),
    "coincident and parallel": ([(0, 0), (10, 0)], [(10, 0), (20, 0)], True),
    "gap that goes on": ([(0, 0), (10, 0)], [(11, 0), (20, 0)], True),
    "ends side by side": ([(0, 0), (10, 0)], [(10, 1), (20, 1)], False),
    "ends side by side, turning": ([(0, 0), (10, 0)], [(10, 1), (10, 20)], True),
    "end on the inside at an angle": ([(0, 0), (10, 0)], [(5, 1), (5, 20)], True),
    "end along the inside": ([(0, 0), (10, 0)], [(5, 1), (25, 2)], False),
    "ten degrees are parallel": ([(0, 0), (100, 0)], [(50, 1), (150, 18.6)], False),
    "thirty degrees are not": ([(0, 0), (100, 0)], [(50, 1), (136.6, 51)], True),
    "too far": ([(0, 0), (10, 0)], [(5, 3), (5, 20)], False),
    "crossing only": ([(0, 0), (10, 0)], [(5, -5), (5, 5)], False),
    "end on a bend": ([(0, 0), (5, 0), (5, 5)], [(5, 0), (10, -5)], True),
}


@pytest.mark.parametrize("swapped", [False, True])
def test_adjacency_by_direction(spark, swapped):
    rows, offset = {}, 0
    for k, (a, b, _) in CASES.items():
        move = lambda v, d=offset: [(x + d, y) for x, y in v]
        rows[f"{k}/{'b' if swapped else 'a'}"], rows[f"{k}/{'a' if swapped else 'b'}"] = move(a), move(b)
        offset += 1000
    found = {r.a.split("/")[0] for r in topology.adjacency(lines(spark, rows), "id", 2.0).collect()}
    assert found == {k for k, (*_, ok) in CASES.items() if ok}


def test_junction_places(spark):
    rows = {"a": [(0, 0), (10, 0)], "b": [(4, 1), (4, 9)], "c": [(10, 0.5), (20, 0)], "d": [(100, 0), (110, 0)]}
    found = {(r.a, r.b, r.at_a, r.at_b) for r in topology.junctions(lines(spark, rows), "id", 2.0).collect()}
    assert {(a, b, round(i, 3), round(j, 3)) for a, b, i, j in found} == {("a", "b", 4.0, 0.0), ("a", "c", 10.0, 0.0), ("a", "c", 10.0, 0.025)}
    pairs = topology.adjacency(lines(spark, rows), "id", 2.0)
    near = {r.id: r.neighbours for r in topology.neighbours(pairs, lines(spark, rows), "id").collect()}
    assert near == {"a": ["b"], "b": ["a"], "c": [], "d": []}  # c starts beside a and runs along it


# Polygons


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def covered(rings, x, y):
    hit = lambda r: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:], strict=False)) % 2 == 1
    return hit(rings[0]) and not any(map(hit, rings[1:]))


def test_union_of_rectangles_equals_inclusion_exclusion(spark):
    r = random.Random(7)
    keys = {k: [(x, y, x + r.randint(1, 9), y + r.randint(1, 9)) for x, y in ((r.randint(0, 12), r.randint(0, 12)) for _ in range(r.randint(1, 7)))] for k in range(25)}
    rows = [(k, [ring([(w, s), (e, s), (e, n), (w, n)][:: r.choice([1, -1])])]) for k, boxes in keys.items() for w, s, e, n in boxes]
    found = {f.key: f for f in noding.union(spark.createDataFrame(rows, f"key long, rings array<{LINE}>"), "key").collect()}
    for k, boxes in keys.items():
        cells = {(x, y) for w, s, e, n in boxes for x in range(w, e) for y in range(s, n)}
        assert math.isclose(found[k].area, len(cells)), k
        area = sum(sum(a.x * b.y - b.x * a.y for a, b in zip(v, v[1:], strict=False)) / 2 for v in found[k].rings)
        assert math.isclose(area, len(cells))


def test_union_of_random_polygons_covers_what_they_cover(spark):
    r = random.Random(11)
    star = lambda: [(5 + r.uniform(-3, 3) + r.uniform(1, 4) * math.cos(t), 5 + r.uniform(1, 4) * math.sin(t)) for t in (i * math.pi / 4 for i in range(8))]
    hole = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (8, 2), (8, 8), (2, 8)]]
    shapes = {0: [[p] for p in (star(), star(), star())], 1: [hole, [[(4, 4), (6, 4), (6, 6), (4, 6)]]], 2: [hole, [[(1, 4), (5, 4), (5, 6), (1, 6)]]], 3: [[[(0, 0), (2, 0), (2, 2), (0, 2)]], [[(2, 0), (4, 0), (4, 3), (2, 3)]]]}
    simple = lambda p: p
    rows = [(k, [ring(simple(x)) for x in rings]) for k, some in shapes.items() for rings in some]
    found = {f.key: [[(p.x, p.y) for p in v] for v in f.rings] for f in noding.union(spark.createDataFrame(rows, f"key long, rings array<{LINE}>"), "key").collect()}
    for k, some in shapes.items():
        if k == 0:  # stars may cross themselves; only convexly ordered ones are compared
            continue
        for _ in range(400):
            x, y = r.uniform(-1, 11), r.uniform(-1, 11)
            inside = sum(sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(v, v[1:], strict=False)) for v in found[k]) % 2 == 1
            assert inside == any(covered([[*rg, rg[0]] for rg in rings], x, y) for rings in some), (k, x, y)
    assert len(found[1]) == 3 and len(found[3]) == 1


def test_union_of_convex_polygons_by_sampling(spark):
    r = random.Random(5)
    convex = lambda: [(cx + a * math.cos(t), cy + b * math.sin(t)) for cx, cy, a, b in [(r.uniform(0, 6), r.uniform(0, 6), r.uniform(1, 3), r.uniform(1, 3))] for t in sorted(r.uniform(0, 6.28) for _ in range(9))]
    some = [convex() for _ in range(12)]
    frame = spark.createDataFrame([("k", [ring(p)]) for p in some] + [("k", [ring(some[0])]), ("k", None), ("k", [])], f"key string, rings array<{LINE}>")
    (found,) = noding.union(frame, "key").collect()
    rings = [[(p.x, p.y) for p in v] for v in found.rings]
    for _ in range(1500):
        x, y = r.uniform(-4, 10), r.uniform(-4, 10)
        inside = sum(sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(v, v[1:], strict=False)) for v in rings) % 2 == 1
        assert inside == any(covered([[*p, p[0]]], x, y) for p in some)


def test_shared_edges_with_other_vertices(spark):
    """Neighbours whose common border has a vertex on one side only, and a third that touches in a point."""
    rows = [("k", [ring([(0, 0), (4, 0), (4, 4), (0, 4)])]), ("k", [ring([(4, 0), (8, 0), (8, 4), (4, 4), (4, 1.5)])]), ("k", [ring([(8, 4), (9, 4), (9, 5)])])]
    (found,) = noding.union(spark.createDataFrame(rows, f"key string, rings array<{LINE}>"), "key").collect()
    assert math.isclose(found.area, 32.5) and found.n_rings == 2


def test_clip_polygon_area_by_sampling(spark):
    r = random.Random(1)
    outer = [(0, 0), (10, 1), (12, 9), (6, 5), (1, 11)]
    hole = [(3, 2), (7, 3), (5, 4)]
    frame = spark.createDataFrame([(1, [ring(outer), ring(hole)]), (2, [ring([(50, 50), (60, 50), (60, 60)])]), (3, None), (4, [ring([(3, 3), (4, 3), (4, 4), (3, 4)]), ring(outer)])], f"id long, rings array<{LINE}>")
    found = {f.id: f for f in frame.select("id", polygons.clip_polygon(F.col("rings"), 2.0, 1.0, 9.0, 7.0).alias("c")).select("id", "c", g.polygon_area(F.col("c")).alias("area")).collect()}
    n = 60_000
    hits = sum(covered([[*outer, outer[0]], [*hole, hole[0]]], x, y) for x, y in ((r.uniform(2, 9), r.uniform(1, 7)) for _ in range(n)))
    assert abs(found[1].area - 42 * hits / n) < 0.25
    assert all(2 <= p.x <= 9 and 1 <= p.y <= 7 for v in found[1].c for p in v) and all(v[0] == v[-1] for v in found[1].c)
    assert found[2].c is None and found[3].c is None


def test_clip_features_of_every_kind(spark):
    geom = lambda kind, polys: {"gtype": kind, "polys": [[[{"x": float(x), "y": float(y)} for x, y in line] for line in poly] for poly in polys]}
    rows = [
        ("p in", geom("Point", [[[(1, 1)]]])),
        ("p out", geom("Point", [[[(9, 9)]]])),
        ("mp", geom("MultiPoint", [[[(1, 1), (9, 9), (5, 5)]]])),
        ("line", geom("LineString", [[[(-5, 2), (2, 2), (2, 9), (4, 9), (4, 2)]]])),
        ("lines", geom("MultiLineString", [[[(0, 1), (3, 1)], [(7, 7), (9, 9)], [(1, 4), (8, 4)]]])),
        ("gone", geom("LineString", [[[(7, 7), (9, 9)]]])),
        ("area", geom("Polygon", [[[(-1, -1), (3, -1), (3, 3), (-1, 3), (-1, -1)]]])),
        ("areas", geom("MultiPolygon", [[[(4, 4), (9, 4), (9, 9), (4, 4)]], [[(10, 10), (11, 10), (11, 11), (10, 10)]]])),
        ("null", None),
    ]
    frame = spark.createDataFrame([(i, n, 7, x) for i, (n, x) in enumerate([*rows, rows[3]])], f"id int, name string, `a.b` int, geom {GEOMETRY}")
    found = clip.clip_features(frame, (0.0, 0.0, 5.0, 5.0)).collect()
    shape = {f.name: (f.geom.gtype, [[xy(v) for v in p] for p in f.geom.polys]) for f in found}
    assert sorted(f.name for f in found) == ["area", "areas", "line", "line", "lines", "mp", "p in"] and all(f["a.b"] == 7 for f in found)
    assert shape["line"] == ("MultiLineString", [[[(0, 2), (2, 2), (2, 5)], [(4, 5), (4, 2)]]])
    assert shape["lines"] == ("MultiLineString", [[[(0, 1), (3, 1)], [(1, 4), (5, 4)]]])
    assert shape["mp"] == ("MultiPoint", [[[(1, 1), (5, 5)]]]) and shape["areas"][0] == "Polygon"
    assert len(shape["area"][1][0][0]) == 5


@pytest.mark.parametrize("rings", [[[(0, 0), (10, 0), (10, 10), (9, 10), (9, 1), (1, 1), (1, 10), (0, 10)]], [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]], [[(0, 0), (1, 9), (2, 1), (3, 9), (4, 0), (2, 0.5)]]])
def test_label_point_is_inside_where_the_mean_is_not(spark, rings):
    frame = spark.createDataFrame([([ring(r) for r in rings],)], f"rings array<{LINE}>")
    p = frame.select(polygons.interior_point(F.col("rings")).alias("p")).first().p
    assert covered([[*r, r[0]] for r in rings], p.x, p.y)


def test_label_point_of_odd_rings(spark):
    frame = spark.createDataFrame([(1, []), (2, None), (3, [[]]), (4, [ring([(2, 3)])]), (5, [ring([(0, 0), (5, 0)])])], f"id int, rings array<{LINE}>")
    found = {r.id: r.p for r in frame.select("id", polygons.interior_point(F.col("rings")).alias("p")).collect()}
    assert found[1] is None and found[2] is None and found[3] is None and (found[4].x, found[4].y) == (2, 3) and (found[5].x, found[5].y) == (0, 0)


# Labels


def test_anchors_prefer_straight_stretches(spark):
    zig = [(x, 100 + (20 if x % 20 else 0)) for x in range(0, 300, 10)]
    rows = {"straight": [(0, 50), (500, 50)], "half": zig + [(x, 100) for x in range(300, 700, 100)], "short": [(0, 10), (20, 10)], "steep": [(30, 0), (30, 400)]}
    segs = polyline.line_segments(lines(spark, rows), "id")
    texts = spark.createDataFrame([(k, 80.0, 12.0) for k in rows], "id string, width double, height double")
    found = labels.anchors(segs, texts, "id", 700.0, 600.0).collect()
    best = {r.id: r for r in found if r.anchor == 0}
    assert sorted(best) == ["half", "steep", "straight"]
    assert best["straight"].fraction == 0.5 and best["straight"].bearing == 0 and math.isclose(best["straight"].straightness, 1) and (best["straight"].x, best["straight"].y) == (250, 50)
    assert abs(abs(best["steep"].bearing) - 90) < 1e-9 and math.isclose(best["steep"].h, 80)
    assert best["half"].fraction > 0.6  # behind the zigzag
    assert all(r.y - r.h / 2 >= 0 and r.y + r.h / 2 <= 390 for r in found)


# Ids


def test_geometry_bytes_against_struct(spark):
    r = random.Random(4)
    shapes = {f"{k}": [(r.uniform(-180, 180), r.choice([0.0, -0.0, 1e-300, r.uniform(-90, 90)])) for _ in range(r.randint(2, 6))] for k in range(30)}
    raw = lambda v: (struct.pack("<BII", 1, 2, len(v)) + b"".join(struct.pack("<dd", *p) for p in v)).hex()
    found = {x.id: x.h.lower() for x in lines(spark, shapes).select("id", wkb.line_hex(F.col("line")).alias("h")).collect()}
    assert found == {k: raw(v) for k, v in shapes.items()}


def test_ids_do_not_see_direction_or_order(spark):
    import hashlib

    geom = lambda kind, *parts: {"gtype": kind, "polys": [[[{"x": float(x), "y": float(y)} for x, y in p] for p in parts]]}
    a, b = [(0, 0), (1, 2), (3, 4)], [(9, 9), (8, 8)]
    rows = [(0, geom("LineString", a)), (1, geom("LineString", a[::-1])), (2, geom("MultiLineString", a, b)), (3, geom("MultiLineString", b[::-1], a[::-1])), (4, geom("MultiLineString", a, a)), (5, geom("Polygon", [*a, a[0]])), (6, geom("Point", [(1, 2)])), (7, None)]
    ids = {r.k: r.i for r in spark.createDataFrame(rows, f"k int, g {GEOMETRY}").select("k", wkb.feature_id(F.lit("src"), F.lit(3), F.col("g")).alias("i")).collect()}
    assert ids[0] == ids[1] and ids[2] == ids[3] and len({ids[k] for k in (0, 2, 4, 5, 6)}) == 5 and ids[7] is None
    digits = min(struct.pack("<BII", 1, 2, 3) + b"".join(struct.pack("<dd", *p) for p in v) for v in (a, a[::-1]))
    assert ids[0] == "n13-" + hashlib.sha256(b"src\0" + b"3\0" + digits).hexdigest()[:24]


# Clouds and styles


def generator(seed):
    value = seed & 0xFFFFFFFF
    while True:
        value = (value + 1831565813) & 0xFFFFFFFF
        t = ((value ^ value >> 15) * (value | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61))) & 0xFFFFFFFF
        yield (t ^ t >> 14) / 4294967296


@pytest.mark.parametrize("seed", [0, 1, 42, 2**32 - 1, -5, 1836671848])
def test_seeded_numbers_and_banks(spark, seed):
    frame = spark.createDataFrame([(seed, k) for k in range(60)], "seed long, k int")
    made = generator(seed)
    assert [r.v for r in frame.select("k", clouds.random(F.col("seed"), F.col("k")).alias("v")).orderBy("k").collect()] == [next(made) for _ in range(60)]
    made = generator(seed)
    edge, y = [(0, 1030 + next(made) * 180, 0.0)], 0.0
    while y < 1080:
        y = min(1080, y + 85 + next(made) * 95)
        edge.append((len(edge), 1010 + next(made) * 220, y))
    one = spark.createDataFrame([(seed,)], "seed long")
    assert [tuple(round(v, 6) for v in (r.step, r.x, r.y)) for r in clouds.edges(one).orderBy("step").collect()] == [tuple(round(v, 6) for v in e) for e in edge]
    wisps = [(55 + next(made) * 620, i / 20 * 1080 + (next(made) - 0.5) * 54, 170 + next(made) * 410, 22 + next(made) * 34, 0.18 + next(made) * 0.22) for i in range(20)]
    assert [tuple(round(v, 6) for v in (r.x, r.y, r.width, r.height, r.opacity)) for r in clouds.wisps(one).orderBy("wisp").collect()] == [tuple(round(v, 6) for v in w) for w in wisps]


def test_style_operators(spark):
    frame = spark.createDataFrame([(1, "rail", None, 6.0), (2, "road", 2.0, 11.0), (3, None, -1.0, 20.0)], "id int, kind string, n double, zoom double")
    get = lambda name: F.col(name) if name in frame.columns else F.lit(None).cast("string")
    of = lambda e: [r.v for r in frame.select("id", style.compile(e, get, F.col("zoom"), F.lit("LineString")).alias("v")).orderBy("id").collect()]
    assert of(["==", ["get", "kind"], "rail"]) == [True, False, False] and of(["!=", ["get", "kind"], "rail"]) == [False, True, True]
    assert of([">", ["get", "n"], 0]) == [False, True, False] and of(["has", "n"]) == [False, True, True] and of(["!", ["has", "n"]]) == [True, False, False]
    assert of(["all", ["has", "n"], ["<", ["get", "n"], 0]]) == [False, False, True] and of(["any", ["==", ["get", "kind"], "road"], [">=", ["zoom"], 20]]) == [False, True, True]
    assert of(["all"]) == [True] * 3 and of(["any"]) == [False] * 3
    assert of(["in", ["get", "kind"], ["literal", ["rail", "tram"]]]) == [True, False, False] and of(["in", "ai", ["get", "kind"]]) == [True, False, False] and of(["in", ["get", "kind"], ["literal", []]]) == [False] * 3
    assert of(["case", ["==", ["get", "kind"], "road"], 2, 3]) == [3, 2, 3]
    assert of(["match", ["get", "kind"], ["rail", "tram"], "a", "road", "b", "c"]) == ["a", "b", "c"]
    assert of(["coalesce", ["get", "n"], 9.0]) == [9.0, 2.0, -1.0] and of(["+", 1, ["*", 2, ["coalesce", ["get", "n"], 0.0]]]) == [1.0, 5.0, -1.0] and of(["-", 5, 2]) == [3] * 3
    assert of(["step", ["zoom"], 0, 6, 1, 12, 2]) == [1, 1, 2] and of(["interpolate", ["linear"], ["zoom"], 5, 0.0, 10, 1.0, 12, 3.0]) == [0.2, 2.0, 3.0]
    assert of(["geometry-type"]) == ["LineString"] * 3 and of(["concat", ["get", "kind"], "-", 1]) == ["rail-1", "road-1", "-1"] and of(["min", 3, 2]) == [2] * 3
    for bad in (["unknown", 1], [], ["interpolate", ["exponential", 2], ["zoom"], 1, 2]):
        with pytest.raises(ValueError):
            style.compile(bad, get, F.col("zoom"))


def test_opacity_is_scaled_around_the_zoom():
    assert style.scaled(0.8, 0.5) == 0.4 and style.scaled(None, 0.25) == 0.25
    assert style.scaled(["interpolate", ["linear"], ["zoom"], 5, 0.2, 9, ["get", "o"]], 0.5) == ["interpolate", ["linear"], ["zoom"], 5, 0.1, 9, ["*", ["get", "o"], 0.5]]
    assert style.scaled(["step", ["zoom"], 0.4, 6, ["get", "o"], 8, 1], 0) == ["step", ["zoom"], 0.0, 6, 0, 8, 0]
    assert style.scaled(["step", ["get", "n"], 1, 6, 2], 0.5) == ["*", ["step", ["get", "n"], 1, 6, 2], 0.5] and style.scaled(["get", "o"], 1) == ["get", "o"]
