"""Media columns: ISO base media files as rows with codec, duration and the byte ranges of keyframes.

``columns`` walks the nested boxes of each file and decodes its sample tables (``stsd``, ``stts``, ``stss``, ``stsc``, ``stsz``,
``stco`` or ``co64``) with numpy; payloads are never decoded, and what lies where is all that it keeps.  ``payload`` slices a track's
bytes out of a file by those ranges.  ``store`` makes such a file from a text: its UTF-8 bytes, with zeros up to a positive multiple
of ``UNIT``, are unsigned 8-bit samples of one sound track; a sample of the container is ``UNIT`` bytes, and each chunk starts with a keyframe.

A null or empty text is ``UNIT`` zero bytes.  Equal texts give equal files: they carry no time and no id.  A null or broken file has no
tracks and says in ``error`` why; a file of any number of boxes and tracks is read whole, and tables that claim more than the file holds
are an error before anything is allocated for them.  Repeated rows give repeated rows; other columns are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_and_text, portions, release, ship

#: Bytes of a stored sample, samples of a chunk, and ticks (here bytes) a second.
UNIT, CHUNK, RATE = 64, 16, 8000
#: Boxes that hold boxes; what any other holds is skipped.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
RANGE = "struct<start: long, size: long>"
TRACK = f"struct<track_id: long, handler: string, codec: string, timescale: long, duration: long, n_samples: long, n_bytes: long, keyframes: array<{RANGE}>, ranges: array<{RANGE}>>"


class Broken(ValueError):
    """A file whose boxes or tables contradict themselves."""


# Writing


def box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    return (struct.pack(">I", size) + kind if size < 2**32 else struct.pack(">I4sQ", 1, kind, size + 8)) + b"".join(body)


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    """A box with a version and flags."""
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def container(payload: bytes, unit: int = UNIT, per_chunk: int = CHUNK, rate: int = RATE) -> bytes:
    """A file with one sound track that holds the payload, whose length is a positive multiple of the unit."""
    n = len(payload) // unit
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks = -(-n // per_chunk)
    runs = [(1, per_chunk, 1)] if n >= per_chunk else []
    if n % per_chunk:
        runs.append((chunks, n % per_chunk, 1))
    keys = np.arange(0, n, per_chunk) + 1
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, rate << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        starts = first + np.arange(chunks, dtype=np.int64) * unit * per_chunk
        wide = first + len(payload) >= 2**32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, unit)),
            full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), np.array(runs, ">u4").tobytes()),
            full(b"stsz", struct.pack(">II", unit, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes()),
        )
        whole = len(payload)
        return box(
            b"moov",
            full(b"mvhd", struct.pack(">QQIQ", 0, 0, rate, whole), struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1),
            box(
                b"trak",
                full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, whole), struct.pack(">8xHHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7),
                box(
                    b"mdia",
                    full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, whole, 0x55C4, 0), version=1),
                    full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
                    box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
                ),
            ),
        )

    start = len(head) + len(moov(0)) + (8 if len(payload) + 8 < 2**32 else 16)
    return head + moov(start) + box(b"mdat", payload)


def padded(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """Bytes of the text, and they with zeros up to a positive multiple of the unit."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


# Reading


def boxes(raw: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the body of each box between two offsets."""
    while start < end:
        if end - start < 8:
            raise Broken("a box without a whole header")
        size, kind = struct.unpack_from(">I4s", raw, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Broken("a box without a whole header")
            (size,) = struct.unpack_from(">Q", raw, body)
            body += 8
        elif size == 0:  # up to the end
            size = end - start
        if size < body - start or start + size > end:
            raise Broken(f"box {kind.decode('latin-1')} ends outside its parent")
        yield kind, body, start + size
        start += size


def walk(raw: bytes, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes, with the kinds of those around them; only boxes that are known to hold boxes are entered."""
    if len(path) > 8:
        raise Broken("boxes nested too deeply")
    for kind, body, stop in boxes(raw, start, end):
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(raw, body, stop, (*path, kind))


def _fields(raw: bytes, form: str, at: int, end: int) -> tuple:
    if at + struct.calcsize(form) > end:
        raise Broken("a table ends before its fields")
    return struct.unpack_from(form, raw, at)


def _rows(raw: bytes, at: int, end: int, width: int, kind: str = ">u4") -> np.ndarray:
    """A counted table of whole numbers behind a version word: the count, then rows of so many."""
    (n,) = _fields(raw, ">I", at + 4, end)
    size = n * width * np.dtype(kind).itemsize
    if at + 8 + size > end:
        raise Broken("a table claims more rows than its box holds")
    return np.frombuffer(raw, kind, n * width, at + 8).astype(np.int64).reshape(n, width)


def _head(raw: bytes, at: int, end: int) -> tuple[int, int]:
    """Timescale and duration of a media header of either version."""
    if _fields(raw, ">B", at, end)[0] == 1:
        return _fields(raw, ">IQ", at + 20, end)
    return _fields(raw, ">II", at + 12, end)


def _sizes(raw: bytes, at: int, end: int) -> np.ndarray:
    size, n = _fields(raw, ">II", at + 4, end)
    if size:
        if size * n > len(raw):
            raise Broken("samples are larger than the file")
        return np.full(n, size, np.int64)
    if at + 12 + 4 * n > end:
        raise Broken("a table claims more rows than its box holds")
    return np.frombuffer(raw, ">u4", n, at + 12).astype(np.int64)


def places(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Where each sample starts, from the chunks' offsets and the runs (first chunk, samples a chunk) of the sample-to-chunk table."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if not len(runs) or not len(chunks) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
        raise Broken("the sample-to-chunk table does not fit the chunks")
    many = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if many.sum() != len(sizes):
        raise Broken("chunks hold another number of samples")
    ends = np.cumsum(sizes)
    first = np.cumsum(many) - many
    before = np.append(0, ends)[first]  # bytes of the track before each chunk
    return np.repeat(chunks - before, many) + ends - sizes


def merged(starts: np.ndarray, sizes: np.ndarray) -> list[dict[str, int]]:
    """Ranges in order; one that starts where the one before ends is joined to it."""
    some = sizes > 0
    starts, sizes = starts[some], sizes[some]
    if not len(starts):
        return []
    new = np.append(True, starts[1:] != starts[:-1] + sizes[:-1])
    at = np.flatnonzero(new)
    return [{"start": int(s), "size": int(n)} for s, n in zip(starts[at], np.add.reduceat(sizes, at), strict=True)]


def track(raw: bytes, start: int, end: int) -> dict:
    """One track's columns."""
    at = {path[-1]: (body, stop) for path, body, stop in walk(raw, start, end, (b"trak",))}
    missing = [k.decode() for k in (b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz") if k not in at]
    if missing or not (b"stco" in at or b"co64" in at):
        raise Broken(f"a track without {', '.join(missing) or 'chunk offsets'}")
    body, stop = at[b"tkhd"]
    (number,) = _fields(raw, ">I", body + (20 if _fields(raw, ">B", body, stop)[0] == 1 else 12), stop)
    timescale, duration = _head(raw, *at[b"mdhd"])
    (handler,) = _fields(raw, ">4s", at[b"hdlr"][0] + 8, at[b"hdlr"][1])
    entries, _, codec = _fields(raw, ">II4s", at[b"stsd"][0] + 4, at[b"stsd"][1])
    if not entries:
        raise Broken("a track without a codec")
    sizes = _sizes(raw, *at[b"stsz"])
    chunks = (_rows(raw, *at[b"co64"], 1, ">u8") if b"co64" in at else _rows(raw, *at[b"stco"], 1))[:, 0]
    starts = places(sizes, chunks, _rows(raw, *at[b"stsc"], 3))
    if len(starts) and (int(starts.min()) < 0 or int((starts + sizes).max()) > len(raw)):
        raise Broken("samples lie outside the file")
    times = _rows(raw, *at[b"stts"], 2)
    if times[:, 0].sum() != len(sizes):
        raise Broken("times are given for another number of samples")
    if b"stss" in at:
        keys = _rows(raw, *at[b"stss"], 1)[:, 0] - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
            raise Broken("a keyframe that is no sample")
    else:  # all are
        keys = np.arange(len(sizes))
    ticks = int((times[:, 0] * times[:, 1]).sum())
    return {
        "track_id": number,
        "handler": handler.decode("latin-1"),
        "codec": codec.decode("latin-1"),
        "timescale": timescale,
        "duration": ticks or min(duration, 2**63 - 1),
        "n_samples": len(sizes),
        "n_bytes": int(sizes.sum()),
        "keyframes": [{"start": int(starts[k]), "size": int(sizes[k])} for k in keys],
        "ranges": merged(starts, sizes),
    }


def tracks(raw: bytes | None) -> tuple[str | None, list[dict]]:
    """Why a file can't be read (or null), and its tracks."""
    if not raw:
        return "no file", []
    try:
        top = list(boxes(raw, 0, len(raw)))
        found = [(b, e) for kind, b, e in top if kind == b"moov"]
        if len(found) != 1:
            return "a file with no movie box, or several", []
        read = [track(raw, b, e) for kind, b, e in boxes(raw, *found[0]) if kind == b"trak"]
        return (None if read else "a movie without tracks"), read
    except Broken as error:
        return str(error), []


def _mapped(rows: DataFrame, function: Callable[[object], tuple], made: dict[str, pa.DataType], schema: str) -> DataFrame:
    """The first column and what a function makes of each value of the second one, by portions of so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in (x for batch in batches for x in portions(batch, 1)):
                found = zip(*map(function, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(found, made.values(), strict=True))], ["row", *made])
        finally:
            release()

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"row {rows.schema[0].dataType.simpleString()}, {schema}")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text) and media (the file) of every row."""

    def one(text: str | None) -> tuple:
        n, raw = padded(text)
        return n, container(raw)

    return _mapped(id_and_text(docs, id_col, text_col), one, {"n_bytes": pa.int64(), "media": pa.binary()}, "n_bytes long, media binary").withColumnRenamed("row", "doc_id")


def columns(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, media, error and tracks of every file, and the columns to keep, whose names are none of these."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
    number, text = pa.int64(), pa.string()
    kind = pa.struct([("track_id", number), ("handler", text), ("codec", text), ("timescale", number), ("duration", number), ("n_samples", number), ("n_bytes", number), ("keyframes", span), ("ranges", span)])
    held = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = files.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), *held).alias("row"), F.col(media_col).cast("binary").alias("media"))
    found = _mapped(rows, lambda raw: (raw, *tracks(raw)), {"media": pa.binary(), "error": text, "tracks": pa.list_(kind)}, f"media binary, error string, tracks array<{TRACK}>")
    return found.select("row.doc_id", *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)], "media", "error", "tracks")


def payload(media: Column, ranges: Column) -> Column:
    """The bytes of a track, sliced out of its file range by range."""
    return F.aggregate(ranges, F.lit(b""), lambda have, r: F.concat(have, F.substring(media, (r["start"] + 1).cast("int"), r["size"].cast("int"))))
