import random
import sqlite3
import struct

import pytest

from wayfold.plans import kernels
from wayfold.sources.geopackage import read_geopackage, wkb


def test_handoffs_need_junctions():
    owners = dict.fromkeys(range(3), "a") | dict.fromkeys(range(3, 6), "low") | dict.fromkeys(range(6, 9), "b")
    rank = {"a": 1, "b": 1, "low": 2, "mid": 2}
    cand = {s: [(1.0, "low"), (2.0, "mid")] for s in range(3, 6)}
    ab = {frozenset(("a", "mid")), frozenset(("mid", "b"))}
    touch = lambda x, y: frozenset((x, y)) in ab
    fixed = kernels.validate_handoffs(owners, rank, cand, touch)
    assert [fixed[s] for s in range(9)] == ["a"] * 3 + ["mid"] * 3 + ["b"] * 3
    ab.clear()
    assert sorted(kernels.validate_handoffs(owners, rank, cand, touch)) == [0, 1, 2, 6, 7, 8]
    ab |= {frozenset(("a", "low")), frozenset(("low", "b"))}
    assert kernels.validate_handoffs(owners, rank, cand, touch) == owners


def test_transition_is_unique_and_not_too_sharp():
    reference = [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)]
    lines = {"a": [(-20.0, 0.0), (0.0, 0.0)], "b": [(20.0, 0.0), (40.0, 0.0)], "m": [(0.0, 0.5), (20.0, 0.5)]}
    go = lambda ls, d=(1.0, 0.0), gap=1: kernels.part_transition("a", gap, (1.0, 0.0), "b", 1, d, ls, reference, {"a", "b"})
    assert go(lines) == ("m",)
    assert go(lines | {"n": [(0.0, -0.5), (20.0, -0.5)]}) is None
    assert go(lines, (0.0, 1.0)) is None and go(lines, gap=3) is None
    halves = {k: v for k, v in lines.items() if k != "m"} | {"x": [(0.0, 0.0), (10.0, 0.0)], "y": [(10.0, 0.0), (20.0, 0.0)]}
    assert go(halves) == ("x", "y")


def test_runs_reach_their_junction(spark):
    runs = spark.createDataFrame([("p", 1, "a", 0.0, 100.0), ("p", 2, "b", 120.0, 200.0), ("p", 3, "c", 300.0, 400.0)], "part string, run int, owner string, from_m double, to_m double")
    met = spark.createDataFrame([("p", "b", "a", 111.0), ("p", "b", "c", 210.0)], "part string, a string, b string, at_m double")
    found = {r["run"]: (r["from_m"], r["to_m"], r["ends"]) for r in kernels.extend_to_junctions(runs, met).collect()}
    assert found == {1: (0.0, 111.0, "end"), 2: (111.0, 200.0, "start"), 3: (300.0, 400.0, "interior")}


def test_clusters_are_complete():
    found = kernels.cluster_means([(0, 0), (1, 0), (2, 0), (0.5, 0)], 1.0)
    assert [k for k, _ in found] == [0, 0, 1, 0] and found[0][1] == (0.5, 0.0)


def test_stitching_takes_the_smallest_gap_and_reverses():
    parts = kernels.stitch([[(0, 0), (10, 0)], [(25, 0), (15, 0)], [(10, 3), (10, 30)], [(300, 0), (310, 0)]])
    assert sorted(parts) == [[(0, 0), (10, 0), (15, 0), (25, 0)], [(10, 3), (10, 30)], [(300, 0), (310, 0)]]


def test_labels_do_not_overlap(spark):
    rng = random.Random(3)
    rows = [(s, i, a, rng.uniform(0, 60), rng.uniform(0, 60), 20.0, 8.0, i % 3) for s in (1, 2) for i in range(15) for a in range(3)]
    found = kernels.place_labels(spark.createDataFrame(rows, "screen int, id int, anchor int, x double, y double, w double, h double, priority int"), "screen", ["priority"]).collect()
    for a in found:
        for b in found:
            assert a is b or a["screen"] != b["screen"] or abs(a["x"] - b["x"]) >= 20 or abs(a["y"] - b["y"]) >= 8
    first = min(i for s, i, *_, p in rows if p == 0)
    assert all(any(r["screen"] == s and r["id"] == first and r["anchor"] == 0 for r in found) for s in (1, 2))


def test_review_queue_goes_round(spark):
    gaps = spark.createDataFrame([("p", k, "unresolved-no-path" if k != 2 else "accepted-auto-connector") for k in range(6)], "part string, gap_id int, decision string")
    some = lambda *k: spark.createDataFrame([(x,) for x in k], "gap_id int")
    assert {r["gap_id"]: r["next"] for r in kernels.review_queue(gaps, some(1), some(4)).collect()} == {0: 3, 3: 5, 5: 0}


def binary(kind, *body):
    return struct.pack("<BI", 1, kind) + b"".join(body)


def points(*ps):
    return struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p) for p in ps)


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        (binary(1, struct.pack("<2d", 1, 2)), ("Point", [[[(1.0, 2.0)]]])),
        (binary(1001, struct.pack("<3d", 1, 2, 3)), ("Point", [[[(1.0, 2.0)]]])),
        (struct.pack(">BI2d", 0, 1, 1, 2), ("Point", [[[(1.0, 2.0)]]])),
        (binary(3, struct.pack("<I", 1), points((0, 0), (1, 0), (0, 0))), ("Polygon", [[[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]])),
        (binary(5, struct.pack("<I", 2), binary(2, points((0, 0), (1, 1))), binary(2, points((2, 2), (3, 3)))), ("MultiLineString", [[[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]])),
        (binary(7, struct.pack("<I", 0)), None),
    ],
)
def test_well_known_binary(raw, found):
    assert wkb(raw) == found


def test_geopackage_layers(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
    con.executemany("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?)", [("roads", 6668), ("posts", 4326)])
    con.execute("CREATE TABLE roads (fid INTEGER PRIMARY KEY, name TEXT, n INTEGER, geom BLOB)")
    con.execute("CREATE TABLE posts (fid INTEGER PRIMARY KEY, geom BLOB)")
    head = b"GP\0\1" + struct.pack("<i", 6668)
    con.executemany("INSERT INTO roads VALUES (?, ?, ?, ?)", [(k, f"r{k}", None if k == 2 else k, None if k == 3 else head + binary(2, points((k, 0), (k, 1)))) for k in range(1, 6)])
    con.commit()
    con.close()
    rows = {r["id"]: r for r in read_geopackage(spark, path, "roads").collect()}
    assert sorted(rows) == list("12345") and rows["2"]["properties"] == {"fid": "2", "name": "r2"} and rows["3"]["geom"] is None
    assert rows["5"]["geom"]["polys"][0][0][1]["y"] == 1.0 and rows["1"]["srs_id"] == 6668
    assert read_geopackage(spark, path, "posts").count() == 0
    with pytest.raises(Exception, match="name one of them"):
        read_geopackage(spark, path).count()
