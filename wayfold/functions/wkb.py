"""Well-known binary as Column builders, and ids from it that neither direction nor order of parts changes.

Bytes are made in the JVM: a double's bits come from ``Double.doubleToRawLongBits`` through Spark's ``java_method``.  Little-endian, two dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Geometry codes of the format.
POINT, LINE, POLYGON = 1, 2, 3


def _turned(digits: Column, size: int) -> Column:
    """Hexadecimal digits with their bytes in reverse order."""
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def _number(n: Column) -> Column:
    return _turned(F.lpad(F.hex(n.cast("long")), 8, "0"), 4)


def _double(x: Column) -> Column:
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("long")
    return F.element_at(F.transform(F.array(F.lpad(F.hex(bits), 16, "0")), lambda d: _turned(d, 8)), 1)


def _vertices(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda p: F.concat(_double(p["x"]), _double(p["y"]))), "")


def _head(code: int) -> Column:
    return F.concat(F.lit("01"), _number(F.lit(code)))


def point_hex(p: Column) -> Column:
    return F.concat(_head(POINT), _double(p["x"]), _double(p["y"]))


def line_hex(line: Column) -> Column:
    return F.concat(_head(LINE), _number(F.size(line)), _vertices(line))


def polygon_hex(rings: Column) -> Column:
    return F.concat(_head(POLYGON), _number(F.size(rings)), F.array_join(F.transform(rings, lambda r: F.concat(_number(F.size(r)), _vertices(r))), ""))


def canonical_hex(geom: Column) -> Column:
    """Digits that tell a geometry from others: a line's are the lesser of both directions, those of a line of several parts are the parts' in order.

    Points and polygons keep their direction; a polygon of several parts is as its parts one behind the other.
    """
    either = lambda line: F.least(line_hex(line), line_hex(F.reverse(line)))
    kind, first = geom["gtype"], F.element_at(geom["polys"], 1)
    return (
        F.when(kind.isin("LineString", "MultiLineString"), F.array_join(F.array_sort(F.transform(first, either)), ""))
        .when(kind == "Point", point_hex(F.element_at(F.element_at(first, 1), 1)))
        .when(kind.isin("Polygon", "MultiPolygon"), F.array_join(F.transform(geom["polys"], polygon_hex), ""))
    )


def feature_id(source: Column, kind: Column, geom: Column, prefix: str = "n13-") -> Column:
    """Prefix and 24 hexadecimal digits from source id, class and geometry; nulls of the first two count as empty, a null geometry gives null."""
    none = F.lit("")
    payload = F.concat(F.coalesce(source.cast("string"), none).cast("binary"), F.lit(b"\0"), F.coalesce(kind.cast("string"), none).cast("binary"), F.lit(b"\0"), F.unhex(canonical_hex(geom)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, 24))


def atom_id(feature: Column, part: Column) -> Column:
    """The id of a feature's part, by its number."""
    return F.concat(feature, F.lit(":"), part.cast("string"))
