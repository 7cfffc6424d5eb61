"""References, fingerprints, snapshots and marking; nearest distances, merged lines and shipping at their edges."""

import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from wayfold.functions import fingerprints
from wayfold.model import LINE
from wayfold.operators import grid, lines, relations
from wayfold.sources import cache, reference, snapshots


def ways(spark, *rows):
    return spark.createDataFrame([(i, tags, [{"x": float(x), "y": float(y)} for x, y in line]) for i, tags, line in rows], f"id string, properties map<string,string>, line {LINE}")


ROAD = [
    ("1", {"ref": "20", "network": "jp", "name": "A"}, [(0, 0), (10, 0)]),
    ("2", {"ref": "4; 20", "network": "jp", "name": "A;B"}, [(10, 0), (20, 0)]),
    ("3", {"ref": "120", "network": "jp"}, [(20, 0), (30, 0)]),
    ("4", {"ref": "20", "network": "other"}, [(40, 0), (50, 0)]),
    ("5", {"ref": "20", "network": "jp", "name:en": "bypass"}, [(60, 0), (70, 0)]),
    ("6", {"ref": "20", "network": "jp"}, [(100, -5), (100, 5)]),
    ("7", {"ref": "20", "network": "jp"}, [(95, 0), (105, 0)]),
    ("8", None, [(0, 9), (1, 9)]),
    ("9", {"ref": "20", "network": "jp"}, [(200, 0), (200, 0)]),
]


def test_reference_by_number(spark):
    config = {"type": "osm-ref", "ref": 20, "network": "jp", "excludeNames": ["bypass"], "excludeIds": [9]}
    found = reference.build(ways(spark, *ROAD), config)
    assert sorted(r.id for r in found["reference"].collect()) == ["1", "2", "6", "7"] and [r.id for r in found["excluded"].collect()] == ["5"]
    assert sorted((r.n_lines, r.length) for r in found["components"].collect()) == [(2, 20.0), (2, 20.0)]  # two that meet, two that cross
    (s,) = found["summary"].collect()
    assert (s.n_members, s.n_ways, s.n_excluded, s.n_components, list(s.lengths), s.ambiguous, s.bridges_added) == (5, 4, 1, 2, [20.0, 20.0], True, 0)


def test_reference_by_name_and_errors(spark):
    rows = ways(spark, *ROAD)
    assert sorted(r.id for r in reference.identified(rows, {"type": "osm-name", "names": ["A"]}).collect()) == ["1", "2"]
    assert [r.id for r in reference.identified(rows, {"type": "osm-name", "names": ["B", "x"], "includeIds": ["2", "3"]}).collect()] == ["2"]
    assert sorted(r.id for r in reference.identified(rows, {"type": "osm-ref", "ref": "20"}).collect()) == ["1", "2", "4", "5", "6", "7", "9"]
    for config, text in (({"type": "osm-ref", "ref": "2"}, "identity"), ({"type": "osm-name", "names": ["B"], "excludeNames": ["A"]}, "exclusions"), ({"type": "osm-name"}, "without names"), ({"type": "x"}, "unknown")):
        with pytest.raises(ValueError, match=text):
            reference.build(rows, config)


def test_fingerprints(spark):
    one, two = '{"b": [2, 1], "a": {"y": 1, "x": "é"}, "presentationType": "p"}', '{"a":{"x":"é","y":1},"manualSelection":{"include":["q"]},"b":[2,1]}'
    rows = spark.createDataFrame([(0, one), (1, two), (2, '{"b":[1,2],"a":{"y":1,"x":"é"}}'), (3, "{"), (4, None), (5, "null")], "k int, t string")
    found = {r.k: r.f for r in rows.select("k", fingerprints.draft_fingerprint(F.col("t")).alias("f")).collect()}
    assert found[0] == found[1] != found[2] and found[3] is None and found[4] is None and found[5] is None
    assert fingerprints.canonical(one) == '{"a":{"x":"é","y":1},"b":[2,1],"presentationType":"p"}'
    lists = spark.createDataFrame([(["b", "a", "b"], None), (["a", "b"], []), ([], ["a", "b"])], "i array<string>, e array<string>")
    got = [r.f for r in lists.select(fingerprints.selection_fingerprint(F.col("i"), F.col("e")).alias("f")).collect()]
    assert got[0] == got[1] == fingerprints.selection_hash(["a", "b"], []) and got[2] == fingerprints.selection_hash([], ["b", "a"])


def test_snapshots_are_written_resolved_and_indexed(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    row = lambda date, name, parent=None, resolution="low": ("geo", "13", resolution, date, name, parent, f"{name}-{date}", "{}")
    schema = "provider string, prefecture string, resolution string, date string, name string, parent string, id string, geom string"
    snapshots.write_snapshot(spark.createDataFrame([row("1920-01-01", "新宿区", "東京市"), row("1920-01-01", "八王子"), row("1950-01-01", "八王子")], schema), root)
    snapshots.write_snapshot(spark.createDataFrame([row("1950-01-01", "Ｎａｍｅ  x"), row("1950-01-01", "八王子", None, "high")], schema), root)  # replaces one, adds one
    rows = snapshots.read_snapshots(spark, root)
    held = snapshots.manifest(rows)
    assert sorted((r.resolution, r.date, r.n_features, r.n_parents) for r in held.collect()) == [("high", "1950-01-01", 1, 0), ("low", "1920-01-01", 2, 1), ("low", "1950-01-01", 1, 0)]
    asked = [(0, "low", "1920-01-01", True), (1, "low", "1900-01-01", False), (2, "low", None, True), (3, "mid", None, False), (4, "high", "1920-01-01", False)]
    wanted = spark.createDataFrame([(k, "geo", "13", r, d, p) for k, r, d, p in asked], "k int, provider string, prefecture string, resolution string, date string, parents boolean")
    found = {r.k: (r.exact, r.resolved, r.problem) for r in snapshots.resolve(wanted, held).collect()}
    assert found == {0: ("1920-01-01", "1920-01-01", None), 1: (None, "1950-01-01", None), 2: (None, "1950-01-01", "no parents"), 3: (None, None, "no snapshot"), 4: (None, "1950-01-01", None)}
    index = snapshots.name_index(rows)
    assert {(r.level, r.name): r.dates for r in index.collect()} == {
        ("municipality", "新宿区"): {"low": ["1920-01-01"]},
        ("municipality", "八王子"): {"low": ["1920-01-01"], "high": ["1950-01-01"]},
        ("municipality", "Ｎａｍｅ  x"): {"low": ["1950-01-01"]},
        ("parent", "東京市"): {"low": ["1920-01-01"]},
    }
    assert [r.name for r in snapshots.search(index, " Name x").collect()] == ["Ｎａｍｅ  x"]


def test_dimming_and_availability(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, id string")
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert sorted(r.k for r in relations.dimmed(rows, pick("a", "a", "z"), "id").collect()) == [2, 3]
    assert relations.dimmed(rows, pick(), "id").count() == 0 and relations.dimmed(rows, pick(None), "id").count() == 0
    files = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("b", "z")], "id string, kind string")
    assert [r.k for r in relations.available(rows, files, "id", "kind", ["x", "y"]).collect()] == [1]


# Nearest distances


def test_nearest_distance_ends_on_any_coordinate(spark):
    r = random.Random(6)
    segs = [(x := r.uniform(-500, 500), y := r.uniform(-500, 500), x + r.uniform(-60, 60), y + r.uniform(-60, 60)) for _ in range(150)] + [(9e5, 9e5, 9e5 + 1, 9e5)]
    pts = [(k, r.uniform(-700, 700), r.uniform(-700, 700)) for k in range(120)] + [(k, r.uniform(-1, 1) * 10 ** r.uniform(0, 7), r.uniform(-1, 1) * 10 ** r.uniform(0, 7)) for k in range(120, 200)]
    odd = [(200, None, 1.0), (201, 1.0, None), (202, float("nan"), 1.0), (203, float("inf"), 1.0), (204, None, None)]
    frame = spark.createDataFrame(segs + [(None, 0.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    found = {x.k: x.distance for x in grid.nearest_distance(spark.createDataFrame(pts + odd, "k int, x double, y double"), frame, ["k"], 5.0).collect()}

    def far(px, py, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = max(0, min(1, ((px - s[0]) * dx + (py - s[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - s[0] - t * dx, py - s[1] - t * dy)

    assert len(found) == 205 and all(found[k] is None for k, *_ in odd)
    for k, x, y in pts:
        assert math.isclose(found[k], min(far(x, y, s) for s in segs), rel_tol=1e-9, abs_tol=1e-9), (k, x, y)
    assert grid.nearest_distance(spark.createDataFrame(pts, "k int, x double, y double"), frame.where("x1 is null"), ["k"], 5.0).count() == 0


# Merged lines


def test_merge_lines_groups_are_chains(spark):
    """A street grid is one network, but nothing in it may be merged; a chain of many lines is."""
    street = [(f"h{i}{j}", [(i, j), (i + 1, j)]) for i in range(6) for j in range(6)] + [(f"v{i}{j}", [(i, j), (i, j + 1)]) for i in range(6) for j in range(6)]
    chain = [(f"c{k:03}", [(100 + k, 50), (101 + k, 50)][:: 1 if k % 3 else -1]) for k in range(40)]
    loop = [("l1", [(0, 200), (1, 201)]), ("l2", [(1, 201), (2, 200)]), ("l3", [(2, 200), (0, 200)]), ("own", [(5, 300), (6, 301), (5, 300)]), ("dot", [(7, 7.5)])]
    fork = [("f1", [(0, 400), (1, 400)]), ("f2", [(1, 400), (1, 401), (0.5, 401)]), ("f3", [(0.5, 401), (1, 400)])]  # a chain whose both ends are at one junction
    rows = [("k", i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in street + chain + loop + fork]
    found = [[(p.x, p.y) for p in r.line] for r in lines.merge_lines(spark.createDataFrame(rows, f"k string, id string, line {LINE}"), "k").collect()]
    size = sorted(map(len, found))
    assert size[-1] == 41 and sum(len(x) == 41 for x in found) == 1
    assert sum(sum(map(math.dist, x, x[1:])) for x in found) == pytest.approx(sum(sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)) for _, p in street + chain + loop + fork))
    assert [x for x in found if len(x) == 4 and x[0] == x[-1]] and any(len(x) == 1 for x in found)
    corners = sum(len(x) == 3 and x[0] != x[-1] and x[0][1] < 100 for x in found)
    assert corners == 1 and (0.0, 400.0) in {x[0] for x in found} | {x[-1] for x in found}  # two ends alone meet at one corner of the grid


def test_dotted_names_stay(spark):
    rows = spark.createDataFrame([(1, {"gtype": "LineString", "polys": [[[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}]]]})], "`a.b` int, geom struct<gtype: string, polys: array<array<array<struct<x: double, y: double>>>>>")
    assert cache.with_bounds(rows).first()["a.b"] == 1


def test_steps_ship_the_package(tmp_path):
    """From another folder, with nothing else used before, Python steps find the package on the workers."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
from wayfold.functions import projection, text
from wayfold.operators import lines
row = spark.createDataFrame([('k', 1, [(0.0, 0.0), (1.0, 0.0)]), ('k', 2, [(1.0, 0.0), (2.0, 1.0)])], 'k string, id long, line array<struct<x: double, y: double>>')
print('text', row.select(text.nfkc(F.lit('Ａ')).alias('t'), text.search_key(F.lit('国道２０号')).alias('s'), projection.to_metres(F.lit(139.8), F.lit(36.0)).alias('p')).first().s)
print('lines', lines.merge_lines(row, 'k').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "text 20" in out.stdout and "lines 1" in out.stdout, out.stderr[-3000:]
