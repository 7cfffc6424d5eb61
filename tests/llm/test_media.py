"""ISO media containers: round trips of what the operator writes, and files of other shapes built by hand."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wayfold.llm import media
from wayfold.llm.queries import op13_media_columns

TEXTS = ["", None, "a", "b" * 64, "c" * 65, "d" * 1024, "e" * 1025, "日本語 " * 500, "nul\x00" * 40, "long " * 60_000]


def box(kind, *body):
    return struct.pack(">I", 8 + sum(map(len, body))) + kind + b"".join(body)


def table(kind, fmt, *rows, lead=b""):
    return box(kind, bytes(4), lead, struct.pack(">I", len(rows)), *[struct.pack(fmt, *r) for r in rows])


def movie(sizes, chunks, runs, times, keys=None, codec=b"avc1", handler=b"vide", wide=False, version=0, track_id=1):
    mdhd = box(b"mdhd", struct.pack(">IQQIQI", 1 << 24, 0, 0, 90_000, 777, 0)) if version else box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 90_000, 777, 0))
    tkhd = box(b"tkhd", struct.pack(">IQQI", 1 << 24, 0, 0, track_id), bytes(64)) if version else box(b"tkhd", struct.pack(">IIII", 0, 0, 0, track_id), bytes(64))
    stbl = box(
        b"stbl",
        box(b"stsd", struct.pack(">II", 0, 1), box(codec, bytes(16))),
        table(b"stts", ">II", *times),
        *([table(b"stss", ">I", *[(k,) for k in keys])] if keys is not None else []),
        table(b"stsc", ">III", *runs),
        box(b"stsz", struct.pack(">III", 0, 0, len(sizes)), *[struct.pack(">I", s) for s in sizes]),
        table(b"co64" if wide else b"stco", ">Q" if wide else ">I", *[(c,) for c in chunks]),
    )
    return box(b"trak", tkhd, box(b"mdia", mdhd, box(b"hdlr", struct.pack(">II", 0, 0), handler, bytes(13)), box(b"minf", stbl)))


def test_round_trip_of_texts(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, None), (2, "a"), (None, "no id")]
    found = media.columns(media.store(documents(rows)), keep=("n_bytes",)).withColumn("payload", media.payload(F.col("media"), F.expr("tracks[0].ranges"))).collect()
    want = sorted((str(i), len((t or "").encode()), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.payload)[: r.n_bytes]) for r in found) == want
    for r in found:
        (track,) = r.tracks
        raw, whole = bytes(r.media), bytes(r.payload)
        assert r.error is None and len(whole) % 64 == 0 and len(whole) >= 64 and not whole[r.n_bytes :].strip(b"\0")
        assert (track.codec, track.handler, track.timescale, track.duration, track.n_samples, track.n_bytes) == ("raw ", "soun", 8000, len(whole), len(whole) // 64, len(whole))
        first = track.ranges[0].start
        assert len(track.ranges) == 1 and raw[first : first + len(whole)] == whole
        assert [(k.start, k.size) for k in track.keyframes] == [(first + at, 64) for at in range(0, len(whole), 1024)]
    assert len({bytes(r.media) for r in found if r.n_bytes == 1}) == 1  # equal texts, equal files


def test_query_columns(spark, documents, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_media_columns(spark, str(tmp_path)).collect():
        n, payload = media.padded(dict(rows)[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        raw = media.container(payload)
        assert (r.media_bytes, r.media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r.seconds == len(payload) / 8000 and r.n_keyframes == -(-len(payload) // 1024)


def test_tables_of_other_shapes():
    """Unequal samples in unequal chunks of two interleaved tracks behind 64-bit and open sizes, with free boxes between."""
    head = box(b"ftyp", b"isom", bytes(4)) + box(b"free", b"junk")
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + 100) + bytes(range(100))
    at = len(head) + 16
    one = movie([10, 20, 5, 15], [at, at + 40, at + 80], [(1, 2, 1), (2, 1, 1)], [(3, 3000), (1, 1500)], keys=[1, 4])
    two = movie([10, 7], [at + 30, at + 60], [(1, 1, 1)], [(2, 1024)], codec=b"mp4a", handler=b"soun", wide=True, version=1, track_id=9)
    tail = box(b"moov", box(b"mvhd", bytes(100)), one, box(b"udta", b"not a box"), two)
    error, found = media.tracks(head + data + tail + struct.pack(">I", 0) + b"free" + b"to the end")
    assert error is None
    assert [(t["track_id"], t["codec"], t["handler"], t["timescale"], t["duration"], t["n_samples"], t["n_bytes"]) for t in found] == [(1, "avc1", "vide", 90_000, 10_500, 4, 50), (9, "mp4a", "soun", 90_000, 2048, 2, 17)]
    assert found[0]["keyframes"] == [{"start": at, "size": 10}, {"start": at + 80, "size": 15}]
    assert found[0]["ranges"] == [{"start": at, "size": 30}, {"start": at + 40, "size": 5}, {"start": at + 80, "size": 15}]
    assert found[1]["keyframes"] == [{"start": at + 30, "size": 10}, {"start": at + 60, "size": 7}]  # no table: every sample


def test_broken_files_say_why(spark):
    good = media.container(bytes(2048))
    claims = good.replace(struct.pack(">II", 64, 32), struct.pack(">II", 64, 2**31))
    deep = b""
    for _ in range(3000):
        deep = box(b"mdia", deep)
    deep = box(b"moov", box(b"trak", deep))
    cases = [None, b"", b"short", good[:200], good[:-100], box(b"ftyp", bytes(8)), good + good, claims, deep, bytes(64), box(b"moov", box(b"trak", box(b"tkhd", bytes(80))))]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "doc_id long, media binary")
    found = {r.doc_id: r for r in media.columns(rows).collect()}
    assert len(found) == len(cases)
    assert all(r.error and r.tracks == [] for i, r in found.items())


@pytest.mark.parametrize("size", [64, 2048])
def test_any_cut_is_an_error(size):
    whole = media.container(bytes(size))
    for cut in range(len(whole)):
        error, found = media.tracks(whole[:cut])
        assert error and not found
    assert media.tracks(whole)[0] is None


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "some text", 5, "x")], "id long, body string, media long, `row.text` string")
    assert media.store(rows, "id", "body").columns == ["doc_id", "n_bytes", "media"]
    files = media.store(rows, "id", "body").withColumn("a.b", F.lit(3))
    assert media.columns(files, keep=("a.b",)).first()["a.b"] == 3
    assert media.columns(media.store(rows.limit(0), "id", "body")).count() == 0


def test_many_ranges_are_sliced_in_order(spark):
    at = 8
    chunks = [at + 20 * k for k in range(50)]
    moov = box(b"moov", movie([7] * 50, chunks, [(1, 1, 1)], [(50, 1)]))
    raw = box(b"mdat", bytes(range(250)) * 4) + moov
    rows = media.columns(spark.createDataFrame([(1, raw)], "doc_id long, media binary"))
    got = rows.select(media.payload(F.col("media"), F.expr("tracks[0].ranges")).alias("p")).first().p
    assert bytes(got) == b"".join(raw[c : c + 7] for c in chunks)
