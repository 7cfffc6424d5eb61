"""A scan of shapefiles: ranges of the index file's records, with the attributes beside them.

The index gives the place of every record, so tasks share a file without reading what is not theirs.  Attributes come from the table of fixed width,
by record number.  The projection file decides what is done to coordinates: degrees stay, web mercator and transverse Mercator become degrees, any
other is an error.  Heights and measures are left out.  Null shapes have a null geometry; deleted rows of the table keep their shapes' order and are left out.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.functions.projection import TransverseMercator
from wayfold.model import GEOMETRY
from wayfold.session import ship
from wayfold.sources.files import exists, opened

ROWS = 25_000
_TYPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    hits = [a for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]]
    return len(hits) % 2 == 1


def polygons_of(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons from rings of which outer ones run clockwise: a hole goes to the smallest outer ring that holds it, or is an outer ring of its own."""
    outers = [r for r in rings if signed_area(r) <= 0] or rings
    out = [[r] for r in outers]
    for hole in (r for r in rings if r not in outers):
        homes = [p for p in out if inside(hole[0], p[0])]
        if homes:
            min(homes, key=lambda p: abs(signed_area(p[0]))).append(hole)
        else:
            out.append([hole])
    return out


def shape_of(content: bytes) -> tuple[str, list] | None:
    """gtype and polys of a record's content."""
    (kind,) = struct.unpack_from("<i", content)
    if kind > 28:
        raise ValueError(f"shape of unknown kind {kind}")
    kind %= 10
    if kind == 0:
        return None
    if kind == 1:
        return "Point", [[[struct.unpack_from("<2d", content, 4)]]]
    if kind == 8:
        (n,) = struct.unpack_from("<i", content, 36)
        return "MultiPoint", [[[tuple(p) for p in np.frombuffer(content, "<f8", 2 * n, 40).reshape(n, 2).tolist()]]]
    if kind not in _TYPES:
        raise ValueError(f"shape of unknown kind {kind}")
    parts, n = struct.unpack_from("<2i", content, 36)
    starts = [*np.frombuffer(content, "<i4", parts, 44).tolist(), n]
    points = [tuple(p) for p in np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2).tolist()]
    lines = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    if kind == 3:
        return ("LineString" if parts == 1 else "MultiLineString"), [lines]
    polys = polygons_of(lines)
    return ("Polygon" if len(polys) == 1 else "MultiPolygon"), polys


def content_of(gtype: str | None, polys: list | None) -> bytes:
    """A record's content from a geometry; outer rings are turned clockwise, holes the other way."""
    if gtype is None or polys is None:
        return struct.pack("<i", 0)
    if gtype == "Point":
        return struct.pack("<i2d", 1, *polys[0][0][0])
    turned = lambda ring, hole: ring if (signed_area(ring) > 0) == hole else ring[::-1]
    lines = [turned(r, k > 0) for p in polys for k, r in enumerate(p)] if "Polygon" in gtype else [line for p in polys for line in p]
    flat = [c for line in lines for c in line]
    xs, ys = [c[0] for c in flat], [c[1] for c in flat]
    box = struct.pack("<4d", min(xs), min(ys), max(xs), max(ys))
    points = struct.pack(f"<{2 * len(flat)}d", *[v for c in flat for v in c])
    if gtype == "MultiPoint":
        return struct.pack("<i", 8) + box + struct.pack("<i", len(flat)) + points
    starts = np.cumsum([0, *[len(line) for line in lines[:-1]]]).tolist()
    return struct.pack("<i", 5 if "Polygon" in gtype else 3) + box + struct.pack(f"<2i{len(lines)}i", len(lines), len(flat), *starts) + points


def converter(wkt: str | None):  # noqa: ANN201
    """What makes degrees of a file's coordinates, from its projection text; nothing is done without one."""
    if not wkt or wkt.lstrip().upper().startswith(("GEOGCS", "GEOGCRS")):
        return None
    if re.search(r"Auxiliary_Sphere|Pseudo.Mercator|3857", wkt, re.I):
        return lambda x, y: (np.degrees(x / 6378137.0), np.degrees(2 * np.arctan(np.exp(y / 6378137.0)) - math.pi / 2))
    if not re.search(r"PROJECTION\s*\[\s*\"Transverse_Mercator\"", wkt, re.I):
        raise ValueError("a projection that this reader doesn't know; reproject the source to EPSG:4326")
    value = lambda name, default: float(m[1]) if (m := re.search(rf'PARAMETER\s*\[\s*"{name}"\s*,\s*([-+.\deE]+)', wkt, re.I)) else default
    a, f = re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([\d.]+)\s*,\s*([\d.]+)', wkt, re.I).groups()
    zone = TransverseMercator(value("latitude_of_origin", 0.0), value("central_meridian", 0.0), value("scale_factor", 1.0), float(a), 1 / float(f))
    east, north = value("false_easting", 0.0), value("false_northing", 0.0)
    return lambda x, y: zone.inverse(x - east, y - north)


def reprojected(shape: tuple[str, list] | None, convert) -> tuple[str, list] | None:  # noqa: ANN001
    if shape is None or convert is None:
        return shape

    def line(points: list) -> list:
        lon, lat = convert(*np.array(points, float).T)
        return list(zip(lon.tolist(), lat.tolist(), strict=True))

    return shape[0], [[line(r) for r in p] for p in shape[1]]


class Table:
    """The attribute table: fields and where its rows are."""

    def __init__(self, head: bytes, encoding: str):
        self.count, self.start, self.width = struct.unpack_from("<IHH", head, 4)
        self.encoding, self.fields, at = encoding, [], 1
        for k in range(32, self.start - 1, 32):
            if head[k] == 0x0D:
                break
            name, kind, size = head[k : k + 11].split(b"\0")[0].decode(encoding, "replace"), chr(head[k + 11]), head[k + 16]
            self.fields.append((name, kind, at, size))
            at += size

    def row(self, raw: bytes) -> dict[str, str] | None:
        """The filled fields of a row as text; null for a deleted row."""
        if raw[:1] == b"*":
            return None
        texts = {name: raw[at : at + size].decode(self.encoding, "replace").strip(" \0") for name, _, at, size in self.fields}
        return {k: v for k, v in texts.items() if v}


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base = re.sub(r"\.shp$", "", options["path"], flags=re.I)
        self.step, self.encoding = int(options.get("rows", ROWS)), options.get("encoding")

    def _text(self, ending: str) -> str | None:
        if not exists(self.base + ending):
            return None
        with opened(self.base + ending) as file:
            return file.read().decode("utf-8", "replace")

    def partitions(self) -> list[_Range]:
        with opened(self.base + ".shx") as file:
            n = (file.size() - 100) // 8
        return [_Range(k, min(n, k + self.step)) for k in range(0, n, self.step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        lo, hi = partition.lo, partition.hi
        if lo == hi:
            return
        convert = converter(self._text(".prj"))
        with opened(self.base + ".shx") as file:
            file.seek(100 + 8 * lo)
            places = np.frombuffer(file.read(8 * (hi - lo)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        rows: list[dict | None] = [{}] * (hi - lo)
        if exists(self.base + ".dbf"):
            with opened(self.base + ".dbf") as file:
                (start,) = struct.unpack_from("<H", file.read(12), 8)
                file.seek(0)
                table = Table(file.read(start), self.encoding or (self._text(".cpg") or "utf-8").strip())
                file.seek(table.start + table.width * lo)
                raw = file.read(table.width * (hi - lo))
            rows = [table.row(raw[k * table.width : (k + 1) * table.width]) for k in range(hi - lo)]
        with opened(self.base + ".shp") as file:
            for k, (at, size) in enumerate(places.tolist()):
                if rows[k] is None:
                    continue
                file.seek(at + 8)
                yield str(lo + k), rows[k], reprojected(shape_of(file.read(size)), convert), lo + k


class Shapefile(DataSource):
    """``spark.read.format("shapefile").option("encoding", "cp932").load(path)`` of a ``.shp`` file with its index beside it."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return f"id string, properties map<string, string>, geom {GEOMETRY}, ord long"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def read_shapefile(spark: SparkSession, path: str, encoding: str | None = None, rows: int = ROWS) -> DataFrame:
    """id (record number from 0), properties (filled fields as text), geom in degrees, ord."""
    ship(spark)
    spark.dataSource.register(Shapefile)
    reader = spark.read.format("shapefile").option("rows", rows)
    return (reader.option("encoding", encoding) if encoding else reader).load(path)
