import json

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.sources import cache, features, requests, topojson


def collection(*found, **more):
    return json.dumps({"type": "FeatureCollection", "features": list(found), **more})


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "id": properties.pop("id", None), "properties": properties, "geometry": {"type": kind, "coordinates": coordinates} if kind else None}


SHAPES = {
    "Point": [1.0, 2.0],
    "LineString": [[0.0, 0.0], [1.0, 1.5]],
    "Polygon": [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]], [[1.0, 0.5], [2.0, 0.5], [2.0, 1.0], [1.0, 0.5]]],
    "MultiLineString": [[[0.0, 0.0], [1.0, 1.0]], [[5.0, 5.0], [6.0, 6.0]]],
    "MultiPolygon": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 5.0]]]],
}


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(collection(*[feature(k, c, id=k, name=k.lower()) for k, c in SHAPES.items()], feature(None, None, id="none")))
    rows = features.read_geojson(spark, str(tmp_path / "a.json"))
    assert [r["id"] for r in rows.orderBy("ord").collect()] == [*SHAPES, "none"]
    assert {r["crs"] for r in rows.collect()} == {"EPSG:4326"}
    back = {json.loads(r["value"])["id"]: json.loads(r["value"]) for r in features.geojson_lines(rows).collect()}
    for k, c in SHAPES.items():
        assert back[k]["geometry"] == {"type": k, "coordinates": c}
        assert back[k]["properties"]["name"] == k.lower()
    assert back["none"]["geometry"] is None


def test_geojson_keeps_nested_properties_and_crs(spark, tmp_path):
    (tmp_path / "a.json").write_text(collection(feature("Point", [1, 2], id="x", nested={"a": [1, 2]}, n=3), crs={"properties": {"name": "EPSG:6668"}}))
    row = features.read_geojson(spark, str(tmp_path)).first()
    assert row["crs"] == "EPSG:6668" and json.loads(row["properties"]["nested"]) == {"a": [1, 2]} and row["properties"]["n"] == "3"


def test_overpass_elements(spark, tmp_path):
    at = lambda *p: [{"lat": y, "lon": x} for x, y in p]
    elements = [
        {"type": "node", "id": 1, "lat": 2.0, "lon": 1.0, "tags": {"railway": "station"}},
        {"type": "way", "id": 2, "geometry": at((0, 0), (1, 1))},
        {"type": "way", "id": 3, "geometry": at((0, 0), (1, 0), (1, 1), (0, 0))},
        {"type": "way", "id": 4, "geometry": at((0, 0), (1, 0), (0, 0))},
        {"type": "relation", "id": 5, "members": [{"type": "way", "ref": 2, "role": "", "geometry": at((0, 0), (1, 1))}, {"type": "node", "ref": 1, "role": "stop"}]},
        {"type": "relation", "id": 6, "tags": {"type": "route"}},
    ]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    rows = {r["id"]: r for r in features.read_overpass(spark, str(tmp_path / "o.json")).collect()}
    kinds = {k: r["geom"] and r["geom"]["gtype"] for k, r in rows.items()}
    assert kinds == {"node/1": "Point", "way/2": "LineString", "way/3": "Polygon", "way/4": "LineString", "relation/5": "MultiLineString", "relation/6": None}
    assert [m["ref"] for m in rows["relation/5"]["members"]] == ["2", "1"]


def test_other_tags_lose_against_columns(spark):
    rows = spark.createDataFrame([({"name": "own", "other_tags": '"name"=>"parsed","ref"=>"7"'},), ({"a": "b"},)], "properties map<string,string>")
    assert [r["properties"] for r in features.expand_other_tags(rows).collect()] == [{"ref": "7", "name": "own"}, {"a": "b"}]


def test_merge_by_identity_takes_the_newer(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, features.merge_by_identity(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def topology(**objects):
    return {
        "type": "Topology",
        "transform": {"scale": [0.5, 0.5], "translate": [10, 20]},
        "arcs": [[[0, 0], [4, 0], [0, 4]], [[4, 4], [-4, 0], [0, -4]]],
        "objects": objects,
    }


def test_topojson_decodes_joins_and_closes(spark, tmp_path):
    shapes = [{"type": "Polygon", "id": "a", "properties": {"name": "x"}, "arcs": [[0, 1]]}, {"type": "MultiPolygon", "id": "b", "properties": {}, "arcs": [[[-2, -1]]]}]
    (tmp_path / "t.json").write_text(json.dumps(topology(city={"type": "GeometryCollection", "geometries": shapes}, other={"type": "GeometryCollection", "geometries": []})))
    rows = {r["id"]: r for r in topojson.read_topojson(spark, str(tmp_path / "t.json")).collect()}
    ring = [(p["x"], p["y"]) for p in rows["a"]["geom"]["polys"][0][0]]
    assert ring == [(10, 20), (12, 20), (12, 22), (10, 22), (10, 20)]
    assert [(p["x"], p["y"]) for p in rows["b"]["geom"]["polys"][0][0]] == ring[::-1]
    assert rows["a"]["properties"] == {"name": "x"}


def test_cache_keeps_other_classes_and_prunes(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    root = str(tmp_path / "cache")
    line = lambda x: {"gtype": "LineString", "polys": [[[(float(x), 0.0), (float(x) + 1, 1.0)]]]}
    schema = f"id string, kind string, geom {features.GEOMETRY}"
    cache.write_cache(spark.createDataFrame([(str(x), str(x % 3), line(x)) for x in range(9)], schema), root, "kind")
    cache.write_cache(spark.createDataFrame([("new", "1", line(50))], schema), root, "kind")
    assert {r["class"]: r["n"] for r in cache.manifest(spark, root).collect()} == {"0": 3, "1": 1, "2": 3}
    assert [r["class"] for r in cache.missing_classes(spark, root, ["0", "5"]).collect()] == ["5"]
    found = cache.read_cache(spark, root, ["0", "2"], (2.5, 0.0, 5.5, 1.0))
    assert sorted(r["id"] for r in found.collect()) == ["2", "3", "5"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "LessThanOrEqual(bbox_west,5.5)" in plan


def test_registry_skips_malformed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "aliases": ["x"]}')
    (tmp_path / "b.json").write_text('{"id": ')
    good, bad = cache.read_registry(spark, str(tmp_path), "id string, aliases array<string>")
    assert [r["id"] for r in good.collect()] == ["a"] and bad.count() == 1


def test_query_text_escapes():
    assert requests.relation_query({"network": 'a"b', "ref": "20"}, (1, 2, 3, 4)) == '[out:json][timeout:180];(relation["network"="a\\"b"]["ref"="20"](2,1,4,3););out body geom;>;out skel geom;'


@pytest.mark.parametrize(("x", "y", "inside"), [(3, 1, True), (1.7, 0.7, False), (5, 1, False), (2.0, 1.5, True)])
def test_point_in_polygon_with_hole(spark, x, y, inside):
    rings = SHAPES["Polygon"]
    df = spark.createDataFrame([([[(a, b) for a, b in r] for r in rings],)], "rings array<array<struct<x: double, y: double>>>")
    assert df.select(g.point_in_polygon(F.lit(float(x)), F.lit(float(y)), F.col("rings"))).first()[0] is inside


def test_areas_and_centroids(spark):
    df = spark.createDataFrame([([[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], [(1.0, 0.5), (2.0, 0.5), (2.0, 1.5), (1.0, 1.5)]],)], "rings array<array<struct<x: double, y: double>>>")
    row = df.select(g.polygon_area(F.col("rings")).alias("area"), g.ring_centroid(F.col("rings")[0]).alias("c"), g.great_circle_km(F.col("rings")[0]).alias("km")).first()
    assert row["area"] == 7.0 and (row["c"]["x"], row["c"]["y"]) == (2.0, 1.0) and 1100 < row["km"] < 1200
