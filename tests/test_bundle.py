import json
import random

import numpy as np
import pytest

from wayfold.functions.projection import TransverseMercator, padded_bounds, utm
from wayfold.model import GEOMETRY, ZONE_IX
from wayfold.operators import dissolve
from wayfold.plans import bundle
from wayfold.sources.features import read_geojson_lines
from wayfold.streaming.ingest import ingest

SCHEMA = f"id string, properties map<string,string>, geom {GEOMETRY}"


def line(i, *points, **properties):
    return (i, properties, {"gtype": "LineString", "polys": [[list(map(lambda p: (float(p[0]), float(p[1])), points))]]})


@pytest.mark.parametrize("zone", [ZONE_IX, utm(139.7)])
def test_projection_round_trips(zone):
    rng = random.Random(1)
    lon = np.array([rng.uniform(138, 141.5) for _ in range(200)])
    lat = np.array([rng.uniform(34, 38) for _ in range(200)])
    tm = TransverseMercator(**zone)
    x, y = tm.forward(lon, lat)
    back = tm.inverse(x, y)
    assert np.abs(back[0] - lon).max() < 1e-8 and np.abs(back[1] - lat).max() < 1e-8


def test_projection_scale_and_origin():
    tm = TransverseMercator(**ZONE_IX)
    x, y = tm.forward(np.array([ZONE_IX["lon0"]] * 2), np.array([36.0, 36.001]))
    assert abs(x).max() < 1e-6 and abs(y[0]) < 1e-6
    assert y[1] == pytest.approx(0.9999 * 110.958, rel=2e-4)


def test_padding_is_in_kilometres():
    w, s, e, n = padded_bounds((139.6, 35.6, 139.8, 35.7), 3)
    assert 3 <= (35.6 - s) * 110.95 < 3.5 and 3 <= (n - 35.7) * 110.95 < 3.5 and w < 139.57 and e > 139.83  # the zone's grid is turned against the degrees


def square(x, y, size=1.0):
    x, y = float(x), float(y)
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def test_dissolve_cancels_shared_edges(spark):
    rows = [("a", [square(0, 0)]), ("a", [square(1, 0)]), ("a", [square(1, 1)]), ("a", [square(0, 1)]), ("b", [square(5, 5)]), ("b", [square(8, 8)]), ("c", [square(0, 0)])]
    rows += [("d", [square(x, y)]) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [("c", [square(0, 0)])]
    found = {r["k"]: r for r in dissolve.dissolve(spark.createDataFrame(rows, "k string, rings array<array<struct<x: double, y: double>>>"), "k").collect()}
    assert {k: (r["n_rings"], r["area"]) for k, r in found.items()} == {"a": (1, 4.0), "b": (2, 2.0), "c": (1, 1.0), "d": (2, 8.0)}
    assert all(ring[0] == ring[-1] for r in found.values() for ring in r["rings"])


def test_project_problems():
    assert bundle.problems({"layers": {"modernRoads": ["r"], "railways": {"mode": "near-modern-roads", "distanceKm": 2}, "stations": {"mode": "bbox"}}}) == []
    assert len(bundle.problems({"layers": {"pixels": {}, "railways": {"mode": "near-modern-roads", "distanceKm": True}, "stations": {}}, "bounds": [1, 2, 0, 3]})) == 4
    assert bundle.problems({"bounds": {"mode": "auto", "paddingKm": 0}}) and not bundle.problems({"bounds": [139, 35, 140, 36]})


def test_near_routes_are_whole_and_once(spark):
    roads = spark.createDataFrame([line("r", (139.70, 35.70), (139.71, 35.70))], SCHEMA)
    routes = spark.createDataFrame([line("near", (139.0, 35.0), (139.705, 35.705)), line("far", (139.0, 35.0), (139.1, 35.0))], SCHEMA)
    found = bundle.near_roads(routes, roads, 1.0).collect()
    assert [r["id"] for r in found] == ["near"] and len(found[0]["geom"]["polys"][0][0]) == 2


def test_memberships_both_ways(spark):
    tracks = spark.createDataFrame([line("1", (0, 0), (1, 1)), line("2", (0, 0), (1, 1))], SCHEMA)
    routes = spark.createDataFrame([line("R", (0, 0), (1, 1)), line("S", (0, 0), (1, 1))], SCHEMA)
    members = spark.createDataFrame([("R", "2", 0), ("R", "1", 1), ("R", "9", 2)], "route string, way string, pos int")
    a, b = bundle.with_memberships(tracks, routes, members)
    assert {r["id"]: r["rail_route_ids"] for r in a.collect()} == {"1": ["R"], "2": ["R"]}
    assert {r["id"]: r["member_way_ids"] for r in b.collect()} == {"R": ["2", "1", "9"], "S": []}


def test_bundle_writes_every_family(spark, tmp_path):
    layers = {"modern-roads": spark.createDataFrame([line("r", (0, 0), (1, 1), name="Road", alt_name="Road", ref="R1"), ("n", {}, None)], SCHEMA)}
    manifest = {r["family"]: (r["n"], r["n_with_geometry"]) for r in bundle.materialise(layers, str(tmp_path / "b")).collect()}
    assert manifest == dict.fromkeys(bundle.FAMILIES, (0, 0)) | {"modern-roads": (2, 1)}
    back = {r["id"]: r for r in read_geojson_lines(spark, str(tmp_path / "b/modern-roads")).collect()}
    assert back["r"]["properties"]["ref"] == "R1" and back["n"]["geom"] is None
    search = {r["id"]: r for r in spark.read.json(str(tmp_path / "b/search")).collect()}
    assert search["r"]["aliases"] == ["R1"] and search["n"]["name"] == "n"


def test_stream_appends_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feature = lambda i, c: json.dumps({"id": str(i), "properties": {"class": c}, "geometry": {"type": "Point", "coordinates": [i, i]}})
    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), "class", str(tmp_path / "state")).awaitTermination()
    (tmp_path / "in/a.json").write_text(f"{feature(1, 'x')}\n{feature(2, 'y')}\n")
    run()
    (tmp_path / "in/b.json").write_text(f"{feature(3, 'x')}\n")
    run()
    run()
    assert sorted((r["id"], r["class"]) for r in spark.read.parquet(str(tmp_path / "out/features")).collect()) == [("1", "x"), ("2", "y"), ("3", "x")]
