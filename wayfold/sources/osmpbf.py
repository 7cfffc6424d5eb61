"""A scan of OSM PBF extracts, block by block, and features from its elements.

A file is a sequence of compressed blocks with their length before them.  The driver reads the lengths only; each partition takes whole
blocks, so any number of tasks share a file.  Packed fields are decoded with numpy.  ``elements`` gives nodes, ways and relations as rows; with a
tag, only those that have it leave the reader.  ``features`` joins the positions of nodes to ways by id, and ways to relations, as Spark joins.

Paths may have any scheme that pyarrow's file systems open on every executor (file, hdfs, s3, gs).  An empty file has no rows; a
block that is cut short, or compressed in another way than zlib, is an error.  Elements without tags have an empty map.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfold.model import GEOMETRY
from wayfold.session import ship
from wayfold.sources.files import listed, opened

KINDS = ("node", "way", "relation")
SCHEMA = "element_type string, element_id long, properties map<string, string>, lon double, lat double, refs array<long>, members array<struct<type: string, ref: long, role: string>>"
ARROW = pa.schema(
    [
        ("element_type", pa.string()),
        ("element_id", pa.int64()),
        ("properties", pa.map_(pa.string(), pa.string())),
        ("lon", pa.float64()),
        ("lat", pa.float64()),
        ("refs", pa.list_(pa.int64())),
        ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))),
    ]
)
#: Compressed bytes of a partition; a block is never divided.
PARTITION = 8 << 20
#: Elements of a block that is written.
BLOCK = 8000


def varints(raw: bytes) -> np.ndarray:
    """Packed varints as unsigned numbers of 64 bits."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    if data[-1] & 0x80:
        raise ValueError("a number is cut short")
    ends = np.flatnonzero(data < 0x80)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.bitwise_or.reduceat((data & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def zigzag(numbers: np.ndarray) -> np.ndarray:
    """Signed numbers whose sign is the last bit."""
    return (numbers >> np.uint64(1)).astype(np.int64) ^ -(numbers & np.uint64(1)).astype(np.int64)


def deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(zigzag(varints(raw)))


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message: an unsigned number, or bytes."""
    at, size = 0, len(raw)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < size:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            if at + n > size:
                raise ValueError("a field is cut short")
            yield key >> 3, raw[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            raise ValueError(f"field of unknown kind {kind}")


def signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def inflated(blob: bytes) -> bytes:
    """The block of a blob."""
    found = dict(fields(blob))
    if 1 in found:
        return found[1]
    if 3 not in found:
        raise ValueError("a block is compressed in a way that this reader doesn't know")
    return zlib.decompress(found[3])


def elements_of(block: bytes, tag: str | None = None, kinds: tuple[str, ...] = KINDS) -> dict[str, list]:
    """Columns of the elements of a block, of some kinds and with a tag if one is named."""
    out: dict[str, list] = {name: [] for name in ARROW.names}
    words: list[str] = []
    groups: list[bytes] = []
    step, lat0, lon0 = 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            words = [w.decode("utf-8", "replace") for n, w in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            step = v
        elif k == 19:
            lat0 = signed(v)
        elif k == 20:
            lon0 = signed(v)
    wanted = words.index(tag) if tag is not None and tag in words else None
    if tag is not None and wanted is None:  # no element of the block has it
        return out

    def add(kind: str, number: int, keys: list[int], values: list[int], lon: float | None = None, lat: float | None = None, refs: list[int] | None = None, members: list[dict] | None = None) -> None:
        if wanted is not None and wanted not in keys:
            return
        row = (kind, number, [(words[k], words[v]) for k, v in zip(keys, values, strict=True)], lon, lat, refs, members)
        for name, value in zip(ARROW.names, row, strict=True):
            out[name].append(value)

    degrees = lambda n, base: 1e-9 * (base + step * n)
    for group in groups:
        for k, v in fields(group):
            if k == 2 and "node" in kinds:
                found = dict(fields(v))
                ids, lats, lons = (deltas(found.get(n, b"")) for n in (1, 8, 9))
                flat = varints(found.get(10, b"")).astype(np.int64).tolist()
                lon, lat = degrees(lons, lon0).tolist(), degrees(lats, lat0).tolist()
                at = 0
                for i, number in enumerate(ids.tolist()):
                    keys, values = [], []
                    while at < len(flat) and flat[at]:
                        keys.append(flat[at])
                        values.append(flat[at + 1])
                        at += 2
                    at += 1
                    add("node", number, keys, values, lon[i], lat[i])
            elif k in (1, 3, 4) and KINDS[(1, 3, 4).index(k)] in kinds:
                found = dict(fields(v))
                keys, values = (varints(found.get(n, b"")).astype(np.int64).tolist() for n in (2, 3))
                if k == 1:
                    number, lat, lon = (int(zigzag(np.array([found.get(n, 0)], np.uint64))[0]) for n in (1, 8, 9))
                    add("node", number, keys, values, degrees(lon, lon0), degrees(lat, lat0))
                elif k == 3:
                    add("way", signed(found.get(1, 0)), keys, values, refs=deltas(found.get(8, b"")).tolist())
                else:
                    roles, types = (varints(found.get(n, b"")).astype(np.int64).tolist() for n in (8, 10))
                    members = [{"type": KINDS[t], "ref": ref, "role": words[r]} for r, ref, t in zip(roles, deltas(found.get(9, b"")).tolist(), types, strict=True)]
                    add("relation", signed(found.get(1, 0)), keys, values, members=members)
    return out


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in ARROW], schema=ARROW)


# Scan


class _Blocks(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        super().__init__((path, places[0][0]))
        self.path, self.places = path, places


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.tag = options["path"], options.get("tag")
        self.kinds = tuple(k.strip() for k in options.get("kinds", ",".join(KINDS)).split(","))
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION)))

    def partitions(self) -> list[_Blocks]:
        out = []
        for path in listed(self.path, ".pbf"):
            places: list[tuple[int, int]] = []
            size = 0
            with opened(path) as file:
                at, end = 0, file.size()
                while at < end:
                    file.seek(at)
                    raw = file.read(4)
                    (n,) = struct.unpack(">I", raw) if len(raw) == 4 else (end,)
                    if at + 4 + n > end:
                        raise ValueError(f"{path} is cut short")
                    head = dict(fields(file.read(n)))
                    start, length = at + 4 + n, head[3]
                    at = start + length
                    if at > end:
                        raise ValueError(f"{path} is cut short")
                    if head[1] != b"OSMData":
                        continue
                    if places and size + length > self.most:
                        out.append(_Blocks(path, places))
                        places, size = [], 0
                    places.append((start, length))
                    size += length
            if places:
                out.append(_Blocks(path, places))
        return out or [_Blocks("", [(0, 0)])]

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as file:
            for start, length in partition.places:
                file.seek(start)
                yield _batch(elements_of(inflated(file.read(length)), self.tag, self.kinds))


class OsmPbf(DataSource):
    """``spark.read.format("osmpbf").option("tag", "railway").option("kinds", "way,relation").load(path)`` of a file or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def read_osmpbf(spark: SparkSession, path: str, tag: str | None = None, kinds: tuple[str, ...] = KINDS, partition_bytes: int = PARTITION) -> DataFrame:
    """The elements of a file or folder, those with a tag if one is named; both choices are made in the reader."""
    ship(spark)
    spark.dataSource.register(OsmPbf)
    reader = spark.read.format("osmpbf").option("kinds", ",".join(kinds)).option("partitionBytes", partition_bytes)
    return (reader.option("tag", tag) if tag else reader).load(path)


def decode(blocks: DataFrame, column: str = "block", tag: str | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The elements of blocks that are a column of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                if raw.is_valid:
                    yield _batch(elements_of(inflated(raw.as_py()), tag, kinds))

    ship(blocks.sparkSession)
    return blocks.select(column).mapInArrow(run, SCHEMA)


# Features


def features(chosen: DataFrame, positions: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """id, properties, geom, element_type, element_id, members of chosen elements.

    positions: element_id, lon, lat of all nodes.  ways: element_id, refs of all ways, if relations are to get the lines of their members.  Nodes are
    points, closed ways of more than three points polygons, other ways lines; relations are the lines of their member ways in order, or have
    no geometry.  A way keeps the vertices that the file has; with fewer than two it is left out, and so is a node without a position.
    """
    at = positions.select(F.col("element_id").alias("ref"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p")).where("p.x is not null")
    build = lambda kind, polys: F.struct(kind.alias("gtype"), polys.alias("polys")).cast(GEOMETRY)

    def lined(rows: DataFrame) -> DataFrame:
        flat = rows.select("element_id", F.posexplode("refs").alias("pos", "ref")).join(at, "ref")
        return flat.groupBy("element_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda r: r["p"]).alias("line")).where(F.size("line") > 1)

    line = F.col("line")
    ring = (F.size(line) > 3) & F.element_at(line, 1).eqNullSafe(F.element_at(line, -1))
    nodes = chosen.where("element_type = 'node' and lon is not null").select("element_type", "element_id", "properties", build(F.lit("Point"), F.array(F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))))).alias("geom"), "members")
    mine = chosen.where("element_type = 'way'")
    whole = mine.join(lined(mine), "element_id").select("element_type", "element_id", "properties", build(F.when(ring, "Polygon").otherwise("LineString"), F.array(F.array(line))).alias("geom"), "members")
    relations = chosen.where("element_type = 'relation'")
    if ways is None:
        bound = relations.select("element_type", "element_id", "properties", F.lit(None).cast(GEOMETRY).alias("geom"), "members")
    else:
        parts = relations.select(F.col("element_id").alias("rel"), F.posexplode("members").alias("pos", "m")).where("m.type = 'way'").select("rel", "pos", F.col("m.ref").alias("element_id"))
        needed = ways.join(parts.select("element_id").distinct(), "element_id", "left_semi")
        lines = parts.join(lined(needed), "element_id").groupBy("rel").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]).alias("lines"))
        geom = F.when(F.col("lines").isNotNull(), build(F.lit("MultiLineString"), F.array("lines")))
        bound = relations.join(lines, relations["element_id"] == lines["rel"], "left").select("element_type", "element_id", "properties", geom.alias("geom"), "members")
    return nodes.unionByName(whole).unionByName(bound).select(F.concat("element_type", F.lit("/"), "element_id").alias("id"), "properties", "geom", "element_type", "element_id", "members")


def read_features(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """The features of a file that have a tag: chosen elements from one scan, positions and member ways from scans of their own kind."""
    positions = read_osmpbf(spark, path, kinds=("node",)).select("element_id", "lon", "lat")
    ways = read_osmpbf(spark, path, kinds=("way",)).select("element_id", "refs")
    return features(read_osmpbf(spark, path, tag), positions, ways)


# Blocks from elements


def _number(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(k: int, value: int | bytes) -> bytes:
    return _number(k << 3) + _number(value) if isinstance(value, int) else _number(k << 3 | 2) + _number(len(value)) + value


def _packed(numbers: list[int], delta: bool = False) -> bytes:
    if delta:
        steps = [b - a for a, b in zip([0, *numbers], numbers, strict=False)]
        numbers = [s << 1 if s >= 0 else (-s << 1) - 1 for s in steps]
    return b"".join(map(_number, numbers))


def encode_block(rows: list[dict], step: int = 100, squeeze: bool = True) -> bytes:
    """A blob with these elements, nodes dense; positions are rounded to ``step`` times 1e-9 degrees."""
    words: dict[str, int] = {"": 0}
    of = lambda w: words.setdefault(w, len(words))
    tags = lambda r: sorted((r["properties"] or {}).items())
    nodes = [r for r in rows if r["element_type"] == "node"]
    groups = []
    if nodes:
        flat = [n for r in nodes for n in (*[of(w) for kv in tags(r) for w in kv], 0)]
        place = lambda c: _packed([round(r[c] * 1e9 / step) for r in nodes], True)
        groups.append(_field(2, _field(1, _packed([r["element_id"] for r in nodes], True)) + _field(8, place("lat")) + _field(9, place("lon")) + _field(10, _packed(flat))))
    for kind, k in (("way", 3), ("relation", 4)):
        some = b""
        for r in rows:
            if r["element_type"] == kind:
                body = _field(1, r["element_id"]) + _field(2, _packed([of(a) for a, _ in tags(r)])) + _field(3, _packed([of(b) for _, b in tags(r)]))
                if kind == "way":
                    body += _field(8, _packed(list(r["refs"]), True))
                else:
                    body += _field(8, _packed([of(m["role"]) for m in r["members"]])) + _field(9, _packed([m["ref"] for m in r["members"]], True)) + _field(10, _packed([KINDS.index(m["type"]) for m in r["members"]]))
                some += _field(k, body)
        if some:
            groups.append(some)
    block = _field(1, b"".join(_field(1, w.encode()) for w in words)) + b"".join(_field(2, x) for x in groups) + (_field(17, step) if step != 100 else b"")
    return _field(2, len(block)) + _field(3, zlib.compress(block)) if squeeze else _field(1, block)


def framed(blob: bytes, kind: bytes = b"OSMData") -> bytes:
    """A blob as it stands in a file."""
    head = _field(1, kind) + _field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def encode(elements: DataFrame, most: int = BLOCK) -> DataFrame:
    """block: blobs of so many elements of a partition each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                rows = batch.slice(at, most).to_pylist()
                for r in rows:
                    r["properties"] = dict(r["properties"] or [])
                yield pa.RecordBatch.from_arrays([pa.array([encode_block(rows)], pa.binary())], ["block"])

    ship(elements.sparkSession)
    names = [f.name for f in ARROW]
    return elements.select(*names).mapInArrow(run, "block binary")
