"""Quality rules: base counts, and compression bands from zstandard.

A text is compressed whole, and in fixed chunks of ``CHUNK`` bytes.  Its ratio is UTF-8 bytes over compressed bytes.
Repetitive text compresses too well and incompressible text (random strings, binary dumps) too badly; how well prose
compresses depends on its length, so ``BANDS`` has limits for each range of lengths.  A text is rejected if its whole
ratio leaves the band of its length, or if more than ``MAX_BAD_CHUNKS`` of its full chunks leave the chunk band.  A last
chunk shorter than half of ``CHUNK`` is joined to the one before.

Null and empty texts have no words and so fail the base rules.  A text of any length is read whole, in time linear in
its length; repeated rows give repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from wayfold.llm.common import id_and_text, per_row

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
MIN_WORDS = 20
#: More than so many per cent of words in repeated windows fail.
MAX_REPEATED = 30
LEVEL = 3
CHUNK = 4096
#: Up to so many bytes: lowest and highest ratio of whole texts.  Ratios grow with length, so each lower limit is set just
#: under the least ratios of real prose at the short end of its range (licences, Python's manual, sf0.1 documents that pass the base rules).
BANDS = (
    (128, 0.95, 3.0),
    (192, 1.04, 3.0),
    (256, 1.11, 3.0),
    (384, 1.19, 4.0),
    (512, 1.28, 4.0),
    (1024, 1.38, 4.0),
    (1536, 1.55, 5.5),
    (2048, 1.63, 5.5),
    (3072, 1.73, 5.5),
    (4096, 1.83, 5.5),
    (8192, 1.93, 7.0),
    (16384, 2.15, 7.0),
    (32768, 2.28, 9.0),
    (65536, 2.33, 9.0),
    (float("inf"), 2.45, 12.0),
)
#: Chunks have 2 to 6 KB: prose of 2 KB starts at 1.76, full chunks of sf0.1 at 1.96.
CHUNK_BAND = (1.75, 6.0)
MAX_BAD_CHUNKS = 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks long, n_chunks long, base_failed boolean, kept boolean"

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of ``WINDOW`` words that the text has twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        keys ^= (each[k : k + n] + np.uint64(k)) * _MIX[k]
        keys = keys << np.uint64(7) | keys >> np.uint64(57)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(maybe).tolist():  # hashes that meet by chance go here
        first = at.setdefault(tuple(words[i : i + WINDOW]), i)
        if first != i:
            for j in (first, i):
                covered[j] += 1
                covered[j + WINDOW] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII spaces
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def bands(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks outside their band, chunks, and whether the text stays."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(raw) / len(compressor.compress(raw))
    low, high = next((a, b) for most, a, b in BANDS if len(raw) <= most)
    starts = list(range(0, max(1, len(raw) - CHUNK // 2), CHUNK)) if len(raw) > CHUNK else [0]
    parts = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
    bad = sum(not CHUNK_BAND[0] <= len(p) / len(compressor.compress(p)) <= CHUNK_BAND[1] for p in parts) if len(parts) > 1 else 0
    return ratio, bad, len(parts), low <= ratio <= high and bad <= MAX_BAD_CHUNKS * len(parts)


def judge(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    base = base_counts(text)
    ratio, bad, chunks, inside = bands((text or "").encode(), compressor)
    failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEATED * base[0]
    return *base, ratio, bad, chunks, failed, not failed and inside


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, ratio, base verdict and ``kept`` of every row."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        rows = [judge(t.as_py(), compressor) for t in batch.column(1)]
        columns = list(zip(*rows, strict=True)) or [()] * 10
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)

    return per_row(id_and_text(docs, id_col, text_col), block, SCHEMA)
