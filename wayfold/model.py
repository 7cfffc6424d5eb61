"""Schemas of the geometry and of the sources; none is inferred."""

from __future__ import annotations

VERTEX = "struct<x: double, y: double>"
LINE = f"array<{VERTEX}>"
#: Polygon, then ring or line, then vertices.  A line has its parts in the first polygon; a point is a line of one vertex.
GEOMETRY = f"struct<gtype: string, polys: array<array<{LINE}>>>"
BBOX = "struct<w: double, s: double, e: double, n: double>"
FEATURE = f"id string, properties map<string, string>, geom {GEOMETRY}, ord long"

#: Public definition of plane rectangular zone IX: origin, scale and the GRS80 ellipsoid.
ZONE_IX = {"lat0": 36.0, "lon0": 139.0 + 50.0 / 60.0, "k0": 0.9999, "a": 6378137.0, "f": 1 / 298.257222101}
