"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector is shared by all thresholds: with latent score s = w.x and ordered thresholds t_1 < ... < t_K,
P(grade >= k) = sigmoid(s - t_k).  Thresholds stay ordered because they are trained as a first value and logs of steps.
x is a presence vector over ``2**BITS`` hashed features: each distinct word (lower-cased letters), and each word's shape
(letters collapsed to a or A, digits to 0, other signs as they are), plus the share of words of each shape.  Features that fewer
than ``MIN_DF`` sampled texts have keep weight 0.

The model is fitted in numpy on the driver to a bounded sample: about ``sample`` rated texts, chosen by a hash of the id, each taken whole.
A text rated several times takes its lowest grade; null grades are left out; a rated id with several texts gives the one with the least hash.  Prediction reads whole texts of all rows
and gives the expected grade, P(grade >= top grade) as ``tail`` and ``kept`` (tail >= ``MIN_TAIL``).  A null or empty text is
scored as one without features and is not kept.  Without any ratings every tail is 0 and nothing is kept.  Repeated rows give repeated
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_and_text, portions, release, ship

BITS = 18
SAMPLE = 6000
MIN_DF = 5
STEPS = 150
RATE = 0.1
DECAY = 1e-4
MIN_TAIL = 0.5
SCHEMA = "doc_id long, expected_grade double, tail double, kept boolean"
_LOWER, _UPPER, _DIGIT = (re.compile(p) for p in (rb"(?:[a-z]|[\x80-\xff])+", rb"[A-Z]+", rb"\d+"))
_PUNCTUATION = b".,;:!?\"'()"


def hashed(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its shape; shapes have the upper half."""
    shape = _DIGIT.sub(b"0", _UPPER.sub(b"A", _LOWER.sub(b"a", word)))
    half = 1 << (BITS - 1)
    return crc32(word.strip(_PUNCTUATION).lower()) % half, half + crc32(shape) % half


@dataclass
class Model:
    weights: np.ndarray
    #: Added for each shape by the share of words that have it.
    shares: np.ndarray
    thresholds: np.ndarray

    def predict(self, texts: list[str | None], held: dict[bytes, tuple[int, int]]) -> np.ndarray:
        """P(grade >= k) for each text and threshold."""
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            ids, share = bag((text or "").encode().split(), held)
            out[i] = self.weights[ids].sum() + (self.shares[share[0]] * share[1]).sum()
        return sigmoid(out[:, None] - self.thresholds[None])


def bag(words: list[bytes], held: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Present buckets; shape buckets with their shares of the words."""
    count = Counter(words)
    if len(held) > 200_000:
        held.clear()
    for w in count:
        if w not in held:
            held[w] = hashed(w)
    if not count:
        return np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0))
    pairs = np.array([held[w] for w in count], np.int64)
    shapes, at = np.unique(pairs[:, 1], return_inverse=True)
    return np.union1d(pairs[:, 0], shapes), (shapes, np.bincount(at, np.fromiter(count.values(), np.float64, len(count))) / len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def train(samples: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """samples: grade from 0, present buckets, shape buckets, shares."""
    size = 1 << BITS
    top = max((x[0] for x in samples), default=0)
    if top == 0:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), np.array([np.inf]))
    grade = np.array([x[0] for x in samples])
    n = len(samples)
    cols = np.concatenate([np.concatenate([x[1], size + x[2]]) for x in samples])
    vals = np.concatenate([np.concatenate([np.ones(len(x[1])), x[3]]) for x in samples])
    rows = np.repeat(np.arange(n), [len(x[1]) + len(x[2]) for x in samples])
    df = np.bincount(cols, minlength=2 * size)
    keep = df[cols] >= MIN_DF
    used, cols = np.unique(cols[keep], return_inverse=True)
    vals, rows = vals[keep], rows[keep]
    w = np.zeros(len(used))
    prior = np.array([np.mean(grade >= k) for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    t = -np.log(prior / (1 - prior))
    free = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    m = [np.zeros_like(w), np.zeros_like(free)]
    v = [np.zeros_like(w), np.zeros_like(free)]
    for step in range(1, STEPS + 1):
        t = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        s = np.bincount(rows, w[cols] * vals, n)
        edge = np.concatenate([np.full((n, 1), 1.0), sigmoid(s[:, None] - t), np.zeros((n, 1))], 1)
        hi, lo = edge[np.arange(n), grade], edge[np.arange(n), grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        ds = -(dhi - dlo) / p / n
        dt = np.zeros(top)
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, dhi / p, 0) / n)
        np.add.at(dt, np.minimum(grade, top - 1), np.where(grade < top, -dlo / p, 0) / n)
        dfree = np.array([dt[k:].sum() for k in range(top)]) * np.concatenate([[1.0], np.exp(free[1:])])
        for x, g, a, b in ((w, np.bincount(cols, ds[rows] * vals, len(used)) + DECAY * w, m[0], v[0]), (free, dfree, m[1], v[1])):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(2 * size, np.float32)
    full[used] = w
    return Model(full[:size], full[size:], np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> Model:
    """ratings: id_col and a whole-number grade from 0."""
    grades = ratings.select(F.col(id_col).cast("long").alias("rated"), F.col(grade_col).cast("int").alias("grade")).where("rated is not null and grade >= 0").groupBy("rated").agg(F.min("grade").alias("grade"))
    n = grades.count()
    chosen = grades.where(F.pmod(F.xxhash64("rated", F.lit(11)), F.lit(1 << 20)) < min(1.0, sample / max(1, n)) * (1 << 20))
    texts = id_and_text(docs, id_col, text_col).join(chosen, F.col("doc_id") == F.col("rated"))
    rows = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("grade").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            out = []
            for doc, text, grade in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, (shapes, share) = bag((text or "").encode().split(), held)
                out.append((doc, grade, ids.astype(np.int32).tobytes(), shapes.astype(np.int32).tobytes(), share.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["doc_id", "grade", "ids", "shapes", "share"])

    ship(docs.sparkSession)
    got = rows.mapInArrow(run, "doc_id long, grade int, ids binary, shapes binary, share binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["ids"], r["share"]))
    return train([(r["grade"], np.frombuffer(r["ids"], np.int32).astype(np.int64), np.frombuffer(r["shapes"], np.int32).astype(np.int64), np.frombuffer(r["share"], np.float32)) for r in got])


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail, kept of every row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in (x for whole in batches for x in portions(whole, 1)):
            texts = batch.column(1).to_pylist()
            p = sent.value.predict(texts, held)
            kept = [bool(x >= min_tail and t) for x, t in zip(p[:, -1], texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1), pa.float64()), pa.array(p[:, -1], pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", "expected_grade", "tail", "kept"])
        del held
        release()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
