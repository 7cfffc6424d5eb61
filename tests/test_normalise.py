"""Historical roads, posts and jurisdictions."""

import pytest

from wayfold.model import FEATURE
from wayfold.sources import normalise

LINE = ("LineString", [[[(0.0, 0.0), (1.0, 1.0)]]])
POINT = ("Point", [[[(0.0, 0.0)]]])
AREA = ("Polygon", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]])


def features(spark, *rows):
    return spark.createDataFrame([(str(k), p, g, k) for k, (p, g) in enumerate(rows)], FEATURE)


def test_roads_keep_their_originals(spark):
    found = normalise.roads(features(spark, ({"numbering": "R003", "name": "", "路線名": " 甲州道中 ", "alt_name": "x"}, LINE), ({}, POINT))).collect()
    assert [(r["route_id"], r["name"], r["alt_name"]) for r in found] == [("R003", "甲州道中", "x")] and "甲州道中" in found[0]["original"]
    with pytest.raises(Exception, match="no valid route id"):
        normalise.roads(features(spark, ({"numbering": "17"}, LINE))).collect()


def test_posts_come_once_and_may_not_disagree(spark):
    one = ({"numbering": "R003", "id": "p1", "name": "post", "jk": "label"}, POINT)
    assert [(r["post_id"], r["label"]) for r in normalise.posts(features(spark, one, one, ({}, LINE))).collect()] == [("p1", "label")]
    with pytest.raises(Exception, match="disagree about p1"):
        normalise.posts(features(spark, one, ({**one[0], "name": "other"}, POINT))).collect()
    with pytest.raises(Exception, match="no id"):
        normalise.posts(features(spark, ({"numbering": "R003"}, POINT))).collect()


@pytest.mark.parametrize(
    ("properties", "name", "parent"),
    [
        ({"N03_003": "東京市", "N03_004": "杉並区"}, "杉並区", "東京市"),
        ({"N03_003": "足立区", "N03_004": None}, "足立区", None),
        ({"N03_004": "横浜市", "N03_005": "鶴見区"}, "鶴見区", "横浜市"),
        ({"name": " 村 ", "parent_name": "郡"}, "村", "郡"),
        ({"city_name": "町", "N03_003": " "}, "町", None),
    ],
)
def test_levels_name_a_jurisdiction(spark, properties, name, parent):
    found = normalise.jurisdictions(features(spark, (properties, AREA)), "source", "tokyo", "1920-01-01").first()
    assert (found["municipalityName"], found["parentJurisdictionName"]) == (name, parent)


def test_ids_follow_the_content(spark):
    rows = [({"name": "a", "STARTYEAR": "1900"}, AREA), ({"name": "b"}, AREA), ({"name": "a"}, AREA)]
    found = normalise.jurisdictions(features(spark, *rows), "source", "tokyo", "1920-01-01").collect()
    ids = [r["jurisdictionId"] for r in found]
    assert ids == sorted(ids) and len(set(ids)) == 2 and all(i.startswith("source:tokyo:1920-01-01:") and len(i.split(":")[-1]) == 20 for i in ids)
    assert {r["sourceStartYear"] for r in found} == {1900, None}
    other = normalise.jurisdictions(features(spark, rows[0]), "source", "tokyo", "1930-01-01").first()
    assert other["jurisdictionId"] not in ids
    for bad, message in ((({"name": "a"}, LINE), "needs an area"), (({}, AREA), "no name"), (({"name": "a"}, None), "needs an area")):
        with pytest.raises(Exception, match=message):
            normalise.jurisdictions(features(spark, bad), "source", "tokyo", "1920-01-01").collect()
    with pytest.raises(ValueError, match="resolution"):
        normalise.jurisdictions(features(spark, rows[0]), "source", "tokyo", "1920", "medium")
