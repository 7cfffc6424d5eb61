"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is lower-cased and cut into words (runs of letters and of anything beyond ASCII).  Each word, between marks for its
ends, gives its byte n-grams of ``SIZES``, hashed into ``2**BITS`` rows of an embedding table; the text is the mean of its
rows, and a linear softmax over that mean gives a probability for each language.  Both tables are trained together by
stochastic gradient descent in numpy on the driver.

Training reads a bounded sample: about ``per_language`` texts of each language that occurs, fewer where they would have more than
``sample_bytes`` bytes shared out over the languages, chosen by a hash of id and text (equal rows count once, so neither a hot id nor a hot
copy can fill it).  Each text is taken whole, and with it two windows of a few
of its words, so that short texts are met too.  A fifth of the sample is not trained on: it sets the temperature that makes the softmax's
probabilities honest.  Prediction reads whole texts, and as mean and softmax are linear before the exponent, sums up rows
of a table by word, so a frequent word is worked out once.

``und`` with score 0 is given to a null text and to one without letters, and to every text if nothing could be learned.  A
prediction is rejected if it is ``und`` or its calibrated score is below ``min_score``.  Repeated rows give repeated rows; ids may be
null, negative or repeated, and other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import plain_names, portions, release, ship
from wayfold.llm.words import WordTable

SIZES = (2, 3, 4)
BITS = 16
DIM = 16
PER_LANGUAGE = 500
SAMPLE_BYTES = 64_000_000
EPOCHS = 6
RATE = 2.0
MIN_SCORE = 0.5
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"
_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_BASE = np.uint64(0x100000001B3)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_BLANK).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every word, word by word within each size, and the word it is of."""
    raw = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    buckets, owners = [], []
    for n in SIZES:
        at = np.arange(max(0, len(raw) - n + 1))
        at = at[at + n <= ends[owner[at]]]
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = (key ^ raw[at + k]) * _BASE
        key ^= key >> np.uint64(29)
        buckets.append(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text (2**BITS at most) and their shares."""
    found, count = np.unique(subwords(words)[0] if words else np.zeros(0, np.int64), return_counts=True)
    return found.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    #: What each bucket adds to each language's logit, over the number of n-grams.
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None], words: WordTable) -> tuple[list[str], list[float]]:
        cut = [words_of(t) if t and self.languages and _LETTER.search(t) else [] for t in texts]
        sums = words.sums(cut)
        logits = (sums[:, 1:] / np.maximum(sums[:, :1], 1) + self.bias) / self.temperature
        p = softmax(logits) if self.languages else np.zeros((len(texts), 1))
        best = p.argmax(1)
        return [self.languages[k] if w else "und" for k, w in zip(best, cut, strict=True)], [float(p[i, k]) if w else 0.0 for i, (k, w) in enumerate(zip(best, cut, strict=True))]

    def rows(self, words: list[bytes]) -> np.ndarray:
        """For each word its number of n-grams and what they add up to."""
        out = np.zeros((len(words), 1 + self.table.shape[1]))
        if words:
            buckets, owner = subwords(words)
            out[:, 0] = np.bincount(owner, minlength=len(words))
            for k in range(self.table.shape[1]):
                out[:, 1 + k] = np.bincount(owner, self.table[buckets, k], len(words))
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], held: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model:
    """samples, held: language, buckets, shares."""
    languages = sorted({x[0] for x in samples})
    code = {x: k for k, x in enumerate(languages)}
    n, rng = len(languages), np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    top, bias = np.zeros((DIM, n), np.float32), np.zeros(n, np.float32)
    steps, done = max(1, EPOCHS * len(samples)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            lang, ids, share = samples[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = share @ table[ids]
            p = softmax((mean @ top + bias)[None])[0]
            p[code[lang]] -= 1
            table[ids] -= rate * share[:, None] * (top @ p)
            top -= rate * np.outer(mean, p)
            bias -= np.float32(0.01) * rate * p
    flat = table @ top if n else np.zeros((1 << BITS, 1), np.float32)
    temperature = 1.0
    known = [x for x in held if x[0] in code]
    if known:
        logits = np.array([share @ flat[ids] + bias for _, ids, share in known])
        truth = np.array([code[x[0]] for x in known])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    return Model(languages, flat.astype(np.float32), bias if n else np.zeros(1, np.float32), temperature)


def fit(docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from the rows that ``where`` allows and whose language is not null."""
    rows = docs.where(F.lit(True) if where is None else where).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not counts:
        return train([], [])
    most = sample_bytes / len(counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["n"], most / max(1, r["bytes"] or 0)))])
    drawn = F.xxhash64("doc_id", "text", F.lit(7))
    chosen = rows.withColumn("drawn", drawn).where(F.pmod("drawn", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).dropDuplicates(["doc_id", "text", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, lang, drawn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text or "")
                rng = np.random.default_rng(drawn % (1 << 64))
                for k in range(3 if len(words) > 12 else 1):
                    start, size = rng.integers(0, len(words) - 10) if k else 0, rng.integers(2, 11)
                    ids, weight = features(words[start : start + size] if k else words)
                    if len(ids):
                        out.append((drawn, k, lang, ids.tobytes(), weight.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["drawn", "part", "lang", "ids", "weight"])

    ship(docs.sparkSession)
    got = chosen.mapInArrow(run, "drawn long, part int, lang string, ids binary, weight binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["drawn"], r["part"], r["lang"], r["ids"]))
    made = [((r["drawn"] >> 20) % 97 % 5 == 0, (r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weight"], np.float32))) for r in got]
    met = {x[0] for held, x in made if not held}
    return train([x for held, x in made if not held or x[0] not in met], [x for held, x in made if held])


@plain_names
def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row; with ``keep``, the rows of docs that are not rejected, as they were."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of a number a language, whatever the input
    names = docs.columns
    at = (names.index(id_col), names.index(text_col)) if keep else (0, 1)
    rows = docs if keep else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(sent.value.rows)
        for batch in batches:
            for part in portions(batch, at[1]):
                yield judged(part, words)
        del words
        release()

    def judged(batch: pa.RecordBatch, words: WordTable) -> pa.RecordBatch:
        langs, scores = sent.value.predict(batch.column(at[1]).to_pylist(), words)
        bad = [x == "und" or s < min_score for x, s in zip(langs, scores, strict=True)]
        if keep:
            return batch.filter(pa.array([not x for x in bad], pa.bool_()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, docs.schema if keep else SCHEMA)
