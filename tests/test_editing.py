"""Merged lines, published folders, story and scene edits, overlays and proximity."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions import edits, routes
from wayfold.functions import text as t
from wayfold.operators import grid, lines, relations
from wayfold.plans import bundle
from wayfold.sources.publish import load_bundle, publish


def test_lines_merge_where_two_ends_meet():
    fork = {1: [(0, 0), (1, 0)], 2: [(2, 0), (1, 0)], 3: [(2, 0), (3, 1)], 4: [(2, 0), (3, -1)]}
    assert lines.chain(fork) == [[(0, 0), (1, 0), (2, 0)], [(2, 0), (3, 1)], [(2, 0), (3, -1)]]
    ring = {1: [(0, 0), (1, 0)], 2: [(1, 0), (1, 1)], 3: [(0, 0), (1, 1)]}
    assert lines.chain(ring) == [[(1, 0), (0, 0), (1, 1), (1, 0)]] or len(lines.chain(ring)[0]) == 4
    assert lines.chain({}) == [] and lines.chain({1: [(0, 0), (1, 0), (0, 0)]}) == [[(0, 0), (1, 0), (0, 0)]]


def test_merged_lines_keep_keys_apart(spark):
    shape = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [("a", 1, shape((0, 0), (1, 0))), ("a", 2, shape((1, 0), (2, 0))), ("b", 1, shape((1, 0), (9, 0))), ("a", 7, shape((5, 5), (6, 6)))]
    found = lines.merge_lines(spark.createDataFrame(rows, "k string, id long, line array<struct<x: double, y: double>>"), "k").collect()
    assert sorted((r["k"], len(r["line"])) for r in found) == [("a", 2), ("a", 3), ("b", 2)]


def test_parts_explode(spark):
    rows = spark.createDataFrame([("f", [[1, 2], [3], [4, 5, 6]])], "id string, parts array<array<int>>")
    assert [(r["part_id"], r["line"]) for r in lines.explode_parts(rows, "id", "parts").collect()] == [("f:0", [1, 2]), ("f:2", [4, 5, 6])]


def test_publishing_replaces_whole_or_not_at_all(spark, tmp_path):
    place = str(tmp_path / "out")
    for n in (3, 5):
        publish(spark, place, lambda p, n=n: spark.range(n).write.parquet(p))
        assert spark.read.parquet(place).count() == n

    def fails(p):
        spark.range(9).write.parquet(p)
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError, match="half way"):
        publish(spark, place, fails)
    assert spark.read.parquet(place).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_bundle_reads_back(spark, tmp_path):
    road = [("r", {"name": "Road"}, ("LineString", [[[(0.0, 0.0), (1.0, 1.0)]]]))]
    schema = "id string, properties map<string,string>, geom struct<gtype: string, polys: array<array<array<struct<x: double, y: double>>>>>"
    publish(spark, str(tmp_path / "one"), lambda p: bundle.materialise({"modern-roads": spark.createDataFrame(road, schema)}, p))
    found = load_bundle(spark, str(tmp_path), "one", bundle.FAMILIES)
    assert found["manifest"].count() == len(bundle.FAMILIES) and found["modern-roads"].first()["properties"]["name"] == "Road" and found["search"].first()["name"] == "Road"
    for bad in ("../one", "One", "", "a/b"):
        with pytest.raises(ValueError, match="unsafe"):
            load_bundle(spark, str(tmp_path), bad, bundle.FAMILIES)


def test_manual_choices_win_and_must_be_sound(spark):
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "k long")
    found = relations.overlay(frame(1, 2, 3, 3), frame(2, 9), frame(1), "k", frame(1, 2, 3, 9))
    assert sorted(map(tuple, found.collect())) == [(2, "accepted-manual", True), (3, "accepted-auto", True), (9, "accepted-manual", False)]
    with pytest.raises(ValueError, match="both"):
        relations.overlay(frame(1), frame(2), frame(2), "k")
    with pytest.raises(ValueError, match="none of"):
        relations.overlay(frame(1), frame(), frame(7), "k", frame(1))
    with pytest.raises(Exception, match="no row has k 5"):
        relations.by_id(frame(1), frame(1, 5), "k").collect()


def test_routes_along_a_long_segment_are_near(spark):
    schema = "id string, properties map<string,string>, geom struct<gtype: string, polys: array<array<array<struct<x: double, y: double>>>>>"
    made = lambda i, *ps: (i, {}, ("LineString", [[[tuple(map(float, p)) for p in ps]]]))
    roads = spark.createDataFrame([made("road", (139.0, 35.0), (139.2, 35.0))], schema)
    routes_ = spark.createDataFrame([made("beside", (138.9, 35.005), (139.3, 35.005)), made("across", (139.1, 34.9), (139.1, 35.1)), made("away", (138.9, 35.02), (139.3, 35.02))], schema)
    assert sorted(r["id"] for r in bundle.near_roads(routes_, roads, 1.0).collect()) == ["across", "beside"]
    assert bundle.near_roads(routes_, roads.limit(0), 1.0).count() == 0


def test_nearest_distance_reaches_as_far_as_needed(spark):
    points = spark.createDataFrame([(k, 10.0**k, 3.0) for k in range(5)], "k long, x double, y double")
    segs = spark.createDataFrame([(-1.0, 0.0, 1.0, 0.0), (-9.0, 0.0, -8.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    found = dict(map(tuple, grid.nearest_distance(points, segs, ["k"], 4.0).collect()))
    assert found == {k: pytest.approx(((10.0**k - 1) ** 2 + 9) ** 0.5) for k in range(5)}


def test_step_edits_leave_bad_requests_alone(spark):
    steps = [("a", "1"), ("b", "2"), ("c", "3")]
    row = spark.createDataFrame([(steps,)], "steps array<struct<key: string, step: string>>")
    s, lit = F.col("steps"), F.lit
    keys = lambda c: F.transform(c, lambda x: x["key"])
    entry = F.struct(lit("n").alias("key"), lit("9").alias("step"))
    got = row.select(
        keys(edits.reorder_step(s, lit(0), lit(2))),
        keys(edits.reorder_step(s, lit(2), lit(0))),
        keys(edits.reorder_step(s, lit(0), lit(3))),
        keys(edits.duplicate_step(s, lit("b"), lit("d"))),
        keys(edits.duplicate_step(s, lit("z"), lit("d"))),
        keys(edits.insert_step(s, lit(None).cast("string"), entry)),
        keys(edits.insert_step(s, lit("a"), entry)),
        F.array(edits.selected_after_delete(s, lit("c"), lit("c")), edits.selected_after_delete(s, lit("a"), lit("a")), edits.selected_after_delete(s, lit("a"), lit("z"))),
    ).first()
    assert ["".join(x) for x in got] == ["bca", "cab", "abc", "abdc", "abc", "abcn", "anbc", "bba"]


def test_route_ids_and_search_forms(spark):
    rows = [({"numbering": "R003"},), ({"route": " ", "ID": "R400-1"},), ({"ID": "17"},), ({"routeId": "R3"},)]
    frame = spark.createDataFrame(rows, "p map<string,string>")
    assert [r[0] for r in frame.select(routes.route_id(F.col("p"), strict=False)).collect()] == ["R003", "R400-1", None, None]
    with pytest.raises(Exception, match="no valid route id"):
        frame.select(routes.route_id(F.col("p"))).collect()
    assert t.search_form("一〇丁目") == "一0丁目" and t.search_form("〇丁目") == "0丁目"
