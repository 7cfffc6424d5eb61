"""A scan of GeoPackage layers as a Python data source; a package is one SQLite file, read in ranges of row numbers."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.model import GEOMETRY

_KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 5: "MultiLineString", 6: "MultiPolygon"}
#: Bytes of the bounds in a package's geometry header, by its indicator.
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def geometry_of(blob: bytes | None) -> tuple | None:
    """gtype and polys of a package's geometry; null for an empty one or a kind that the schema does not have."""
    if not blob or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return wkb(blob[8 + _ENVELOPE[blob[3] >> 1 & 7] :])


def wkb(raw: bytes) -> tuple | None:
    """gtype and polys of well-known binary, heights and measures left out."""
    at = 0

    def read(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(mark + form, raw, at)
        at += struct.calcsize("<" + form)
        return out

    def line() -> list[tuple[float, float]]:
        return [read(f"{size}d")[:2] for _ in range(read("I")[0])]

    def head() -> tuple[int, int]:
        nonlocal at, mark
        mark = "<" if raw[at] == 1 else ">"
        at += 1
        kind = read("I")[0]
        flags, kind = kind >> 28, kind & 0x0FFFFFFF
        return kind % 1000, 2 + (kind // 1000 in (1, 3)) + (kind // 1000 in (2, 3)) + (flags >> 3 & 1) + (flags >> 2 & 1)

    mark = "<"
    kind, size = head()
    if kind not in _KINDS:
        return None
    if kind == 1:
        polys = [[[read(f"{size}d")[:2]]]]
    elif kind == 2:
        polys = [[line()]]
    elif kind == 3:
        polys = [[line() for _ in range(read("I")[0])]]
    else:
        parts = []
        for _ in range(read("I")[0]):
            inner, size = head()
            parts.append([line()] if inner == 2 else [line() for _ in range(read("I")[0])])
        polys = [[p[0] for p in parts]] if kind == 5 else parts
    return _KINDS[kind], polys


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.layer, self.step = options["path"], options.get("layer"), int(options.get("rows", 25_000))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def _layer(self, con: sqlite3.Connection) -> tuple[str, str, int]:
        found = con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        some = [x for x in found if x[0] == self.layer] if self.layer else found
        if len(some) != 1:
            raise ValueError(f"the package has layers {', '.join(x[0] for x in found)}; name one of them")
        return some[0]

    def partitions(self) -> list[_Rows]:
        con = self._open()
        table = self._layer(con)[0]
        lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        con.close()
        return [_Rows(k, min(hi, k + self.step - 1)) for k in range(lo, hi + 1, self.step)] if lo is not None else [_Rows(0, -1)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        con = self._open()
        table, column, srs = self._layer(con)
        rows = con.execute(f'SELECT rowid AS _row, * FROM "{table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (partition.lo, partition.hi))
        names = [x[0] for x in rows.description]
        for row in rows:
            values = dict(zip(names, row, strict=True))
            number, blob = values.pop("_row"), values.pop(column)
            yield str(number), {k: str(v) for k, v in values.items() if v is not None and not isinstance(v, bytes)}, geometry_of(blob), int(number), int(srs)
        con.close()


class GeoPackage(DataSource):
    """``spark.read.format("geopackage").option("layer", name).load(path)`` after registering; the path must be one that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return f"id string, properties map<string, string>, geom {GEOMETRY}, ord long, srs_id int"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """id, properties, geom, ord and srs_id of a layer; of the only one if none is named."""
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("geopackage")
    return (reader.option("layer", layer) if layer else reader).load(path)
