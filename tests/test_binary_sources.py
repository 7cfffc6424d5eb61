"""Extract files, shapefiles and downloads: files that the test writes, against what went into them."""

import io
import json
import random
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions.projection import TransverseMercator
from wayfold.sources import downloads, osmpbf, shapefile


def node(i, lon, lat, **tags):
    return {"element_type": "node", "element_id": i, "properties": tags, "lon": lon, "lat": lat, "refs": None, "members": None}


def way(i, refs, **tags):
    return {"element_type": "way", "element_id": i, "properties": tags, "lon": None, "lat": None, "refs": refs, "members": None}


def relation(i, members, **tags):
    return {"element_type": "relation", "element_id": i, "properties": tags, "lon": None, "lat": None, "refs": None, "members": [dict(zip(("type", "ref", "role"), m, strict=True)) for m in members]}


ELEMENTS = [
    [node(1, 139.7, 35.6), node(-2, -0.1234567, 0.0, railway="station", name="駅"), node(3, 139.8, 35.7), node(2**40, 179.9999999, -89.5)],
    [way(10, [1, 3, 2**40], railway="rail", ref="1;2"), way(11, [1, 3, -2, 1], railway="platform"), way(12, [3, 1], highway="path"), way(13, [1], railway="x")],
    [relation(20, [("way", 12, "forward"), ("node", 1, ""), ("way", 10, "")], railway="route"), relation(21, [("way", 999, "")], railway="lost"), relation(22, [], type="none")],
]


@pytest.fixture
def extract(tmp_path):
    head = osmpbf.framed(osmpbf._field(1, b"head"), b"OSMHeader")
    path = tmp_path / "some.osm.pbf"
    path.write_bytes(head + b"".join(osmpbf.framed(osmpbf.encode_block(rows, squeeze=k != 1)) for k, rows in enumerate(ELEMENTS)))
    return str(path)


def plain(r):
    out = r.asDict(recursive=True)
    return {**out, "lon": out["lon"] and round(out["lon"], 7), "lat": out["lat"] and round(out["lat"], 7)}


def test_every_element_comes_back(spark, extract):
    found = sorted(map(plain, osmpbf.read_osmpbf(spark, extract).collect()), key=lambda r: r["element_id"])
    assert found == sorted((r for rows in ELEMENTS for r in rows), key=lambda r: r["element_id"])


def test_a_partition_is_a_block_where_blocks_are_large(spark, extract):
    assert osmpbf.read_osmpbf(spark, extract, partition_bytes=1).rdd.getNumPartitions() == 3
    assert osmpbf.read_osmpbf(spark, extract).rdd.getNumPartitions() == 1
    assert osmpbf.read_osmpbf(spark, extract, partition_bytes=1).count() == sum(map(len, ELEMENTS))


def test_tag_and_kinds_are_chosen_in_the_reader(spark, extract):
    assert sorted(r.element_id for r in osmpbf.read_osmpbf(spark, extract, "railway").collect()) == [-2, 10, 11, 13, 20, 21]
    assert sorted(r.element_id for r in osmpbf.read_osmpbf(spark, extract, "railway", ("way",)).collect()) == [10, 11, 13]
    assert osmpbf.read_osmpbf(spark, extract, "no such tag").count() == 0


def test_features_have_positions_and_member_lines(spark, extract):
    found = {r.id: r for r in osmpbf.read_features(spark, extract, "railway").collect()}
    assert sorted(found) == ["node/-2", "relation/20", "relation/21", "way/10", "way/11"]  # a way of one vertex has no line
    flat = lambda r: [[(round(p.x, 7), round(p.y, 7)) for p in line] for poly in r.geom.polys for line in poly]
    assert found["way/10"].geom.gtype == "LineString" and flat(found["way/10"]) == [[(139.7, 35.6), (139.8, 35.7), (179.9999999, -89.5)]]
    assert found["way/11"].geom.gtype == "Polygon"  # four points that close
    assert found["relation/20"].geom.gtype == "MultiLineString" and [len(x) for x in flat(found["relation/20"])] == [2, 3]
    assert found["relation/21"].geom is None and found["node/-2"].properties["name"] == "駅"


@pytest.mark.parametrize("cut", [1, 3, 20, 60])
def test_files_cut_short_are_errors(spark, extract, tmp_path, cut):
    whole = open(extract, "rb").read()
    path = tmp_path / "cut.pbf"
    path.write_bytes(whole[:-cut])
    with pytest.raises(Exception, match="cut short"):
        osmpbf.read_osmpbf(spark, str(path)).collect()


def test_empty_file_and_unknown_compression(spark, tmp_path):
    (tmp_path / "empty.pbf").write_bytes(b"")
    assert osmpbf.read_osmpbf(spark, str(tmp_path / "empty.pbf")).count() == 0
    with pytest.raises(ValueError, match="compressed"):
        osmpbf.inflated(osmpbf._field(4, b"lzma"))


def test_varints_against_a_loop():
    r = random.Random(1)
    numbers = [0, 1, 127, 128, 2**32, 2**63, 2**64 - 1, *[r.getrandbits(r.randint(1, 64)) for _ in range(500)]]
    assert osmpbf.varints(b"".join(map(osmpbf._number, numbers))).tolist() == numbers
    signed = [0, -1, 1, 2**62, -(2**62), *[r.randint(-(2**60), 2**60) for _ in range(300)]]
    assert osmpbf.deltas(osmpbf._packed(signed, True)).tolist() == signed


def test_random_elements_go_round(spark):
    r = random.Random(3)
    rows = [node(i, round(r.uniform(-180, 180), 7), round(r.uniform(-90, 90), 7), **{f"k{j}": str(r.random()) for j in range(r.randint(0, 3))}) for i in r.sample(range(10**9), 400)]
    frame = spark.createDataFrame(rows, osmpbf.SCHEMA)
    back = osmpbf.decode(osmpbf.encode(frame.repartition(3), most=50))
    assert sorted(map(plain, back.collect()), key=lambda x: x["element_id"]) == sorted(rows, key=lambda x: x["element_id"])


# Shapefiles

SHAPES = [
    ("Point", [[[(1.5, -2.25)]]]),
    ("LineString", [[[(0.0, 0.0), (1.0, 1.0), (2.0, 0.5)]]]),
    (None, None),
    ("MultiLineString", [[[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 5.0), (7.0, 6.0)]]]),
    ("Polygon", [[[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]]),
    ("MultiPolygon", [[[(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)]], [[(20.0, 0.0), (20.0, 4.0), (24.0, 4.0), (20.0, 0.0)], [(21.0, 2.0), (22.0, 3.0), (21.0, 3.0), (21.0, 2.0)]]]),
    ("MultiPoint", [[[(1.0, 2.0), (3.0, 4.0)]]]),
]


def write_shapefile(base, shapes, rows, prj=None, deleted=()):
    contents = [shapefile.content_of(*s) for s in shapes]
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i8d", 1000, 0, *[0.0] * 8)
    body = index = b""
    at = 100
    for k, c in enumerate(contents):
        body += struct.pack(">2i", k + 1, len(c) // 2) + c
        index += struct.pack(">2i", at // 2, len(c) // 2)
        at += 8 + len(c)
    base.with_suffix(".shp").write_bytes(head(100 + len(body)) + body)
    base.with_suffix(".shx").write_bytes(head(100 + len(index)) + index)
    names = sorted({k for r in rows for k in r})
    width = 1 + 12 * len(names)
    table = struct.pack("<B3xIHH20x", 3, len(rows), 33 + 32 * len(names), width) + b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([12, 0]) + bytes(14) for n in names) + b"\r"
    table += b"".join((b"*" if k in deleted else b" ") + b"".join(str(r.get(n, "")).encode("cp932").ljust(12) for n in names) for k, r in enumerate(rows))
    base.with_suffix(".dbf").write_bytes(table + b"\x1a")
    base.with_suffix(".cpg").write_text("cp932")
    if prj:
        base.with_suffix(".prj").write_text(prj)
    return str(base.with_suffix(".shp"))


def flat(geom):
    return geom and (geom.gtype, [[[(p.x, p.y) for p in r] for r in poly] for poly in geom.polys])


def test_shapefile_comes_back_in_any_number_of_tasks(spark, tmp_path):
    rows = [{"N13_003": k % 3 + 1, "name": f"道{k}"} for k in range(len(SHAPES))]
    path = write_shapefile(tmp_path / "some", SHAPES, rows, 'GEOGCS["JGD2011"]', deleted=(1,))
    frame = shapefile.read_shapefile(spark, path, rows=2)
    assert frame.rdd.getNumPartitions() == 4
    found = {r.ord: r for r in frame.collect()}
    assert sorted(found) == [0, 2, 3, 4, 5, 6]
    for k, r in found.items():
        assert flat(r.geom) == (SHAPES[k] if SHAPES[k][0] else None) and r.properties == {n: str(v) for n, v in rows[k].items()}


def test_heights_and_measures_are_left_out():
    line = shapefile.content_of("LineString", [[[(0.0, 0.0), (3.0, 4.0)]]])
    high = struct.pack("<i", 13) + line[4:] + struct.pack("<4d", 0, 9, 1, 2)
    assert shapefile.shape_of(high) == ("LineString", [[[(0.0, 0.0), (3.0, 4.0)]]])
    assert shapefile.shape_of(struct.pack("<i4d", 11, 5.0, 6.0, 7.0, 8.0)) == ("Point", [[[(5.0, 6.0)]]])
    with pytest.raises(ValueError, match="unknown kind"):
        shapefile.shape_of(struct.pack("<i", 31) + bytes(60))


def test_reprojection_to_degrees(spark, tmp_path):
    zone = TransverseMercator(36.0, 139 + 50 / 60, 0.9999, 6378137.0, 1 / 298.257222101)
    east, north = zone.forward(np.array([139.75]), np.array([35.68]))
    prj = 'PROJCS["zone 9",GEOGCS["JGD2011",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101]]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",36],PARAMETER["central_meridian",139.833333333333333],PARAMETER["scale_factor",0.9999],PARAMETER["false_easting",500],PARAMETER["false_northing",0]]'
    path = write_shapefile(tmp_path / "metres", [("Point", [[[(float(east[0]) + 500, float(north[0]))]]])], [{"a": 1}], prj)
    p = shapefile.read_shapefile(spark, path).first().geom.polys[0][0][0]
    assert abs(p.x - 139.75) < 1e-8 and abs(p.y - 35.68) < 1e-8
    web = write_shapefile(tmp_path / "web", [("Point", [[[(15550408.9, 4257980.7)]]])], [{"a": 1}], 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere"]')
    q = shapefile.read_shapefile(spark, web).first().geom.polys[0][0][0]
    assert abs(q.x - 139.6917) < 1e-3 and abs(q.y - 35.6895) < 2e-3
    odd = write_shapefile(tmp_path / "odd", SHAPES[:1], [{"a": 1}], 'PROJCS["x",PROJECTION["Lambert_Conformal_Conic_2SP"]]')
    with pytest.raises(Exception, match="projection"):
        shapefile.read_shapefile(spark, odd).collect()


def test_empty_shapefile(spark, tmp_path):
    assert shapefile.read_shapefile(spark, write_shapefile(tmp_path / "none", [], [])).count() == 0


# Downloads


def package(*layers):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
    con.executemany("INSERT INTO gpkg_contents VALUES (?, 'features')", [(x,) for x in layers])
    con.commit()
    return con.serialize()


def archive(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, n.encode() * 3)
    return out.getvalue()


def test_contents_are_judged_by_themselves(spark, tmp_path):
    files = {
        "page.geojson": b"  <!DOCTYPE html><p>sorry",
        "page.zip": b"<HTML>",
        "good.geojson": json.dumps({"type": "FeatureCollection", "features": []}).encode(),
        "broken.geojson": b'{"type": "FeatureCollection", "features": [',
        "other.json": b'{"type": "Feature"}',
        "list.json": b"[1, 2]",
        "latin.json": '{"a": "\xe9"}'.encode("latin-1"),
        "not.gpkg": archive("a.gpkg"),
        "good.gpkg": package("b", "a"),
        "bare.gpkg": package(),
        "torn.gpkg": b"SQLite format 3\0" + bytes(50),
        "good.zip": archive("a"),
        "not.zip": b"PK\x03\x04 but nothing",
        "what.txt": b"text",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    found = {r.path.rsplit("/", 1)[1]: (r.problem, r.layers) for r in downloads.judged(downloads.read_files(spark, str(tmp_path))).collect()}
    assert found == {
        "page.geojson": ("an HTML document", []),
        "page.zip": ("an HTML document", []),
        "good.geojson": (None, []),
        "broken.geojson": ("not valid JSON", []),
        "other.json": ("not a FeatureCollection", []),
        "list.json": ("not a FeatureCollection", []),
        "latin.json": ("not valid JSON", []),
        "not.gpkg": ("no SQLite header", []),
        "good.gpkg": (None, ["a", "b"]),
        "bare.gpkg": ("no readable layers", []),
        "torn.gpkg": ("no readable layers", []),
        "good.zip": (None, []),
        "not.zip": ("not a ZIP archive", []),
        "what.txt": ("an unknown format", []),
    }
    assert downloads.problem(b"{}", "geojson", "text/HTML; x") == ("an HTML document", []) and downloads.problem(None, "zip")[0] == "no content" and downloads.problem(b"", "zip")[0] == "not a ZIP archive" and downloads.problem(b"x", "zip", None, 503)[0] == "not a success status"


def test_archive_members(spark):
    cases = {"one": archive("docs/", "in/a.GPKG", "b.txt"), "two": archive("a.gpkg", "b.gpkg"), "none": archive("x.txt"), "up": archive("../a.gpkg"), "root": archive("/a.gpkg"), "torn": b"no"}
    frame = spark.createDataFrame(list(cases.items()), "path string, content binary")
    found = {r.path: r for r in downloads.extracted(frame).collect()}
    assert {k: (r.member, r.problem) for k, r in found.items()} == {
        "one": ("in/a.GPKG", None),
        "two": (None, "2 members fit"),
        "none": (None, "0 members fit"),
        "up": (None, "an unsafe member name"),
        "root": (None, "an unsafe member name"),
        "torn": (None, "not a ZIP archive"),
    }
    assert bytes(found["one"].content) == b"in/a.GPKG" * 3
    assert downloads.member(cases["two"], "b.gpkg")[0] == "b.gpkg" and downloads.member(cases["two"], "c.gpkg")[1] == "0 members fit"
    assert downloads.judged(frame.limit(0), expected=F.lit("zip")).count() == 0
