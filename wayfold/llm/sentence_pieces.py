"""SentencePiece encoding and decoding: the N best segmentations of a text over its piece lattice.

The lattice of a text has a node before and after each character of its normalised form and an edge for every piece of the
model that stands there, with the piece's score; a character that no piece holds alone has an edge of its byte pieces, with
the lowest score less ``UNKNOWN``.  A merge model has no scores for that but ranks of its merges, from 0 in whole numbers, and sums of ranks
are no likelihood: its pieces score the log of a frequency that follows from the rank by the law of Zipf and Mandelbrot, -log(rank + ``ZIPF``).  The best
path then takes about as many pieces as the library's merges, not always the same ones (figures in README).  Forward Viterbi scores are the exact best value up to each node, and so an
exact heuristic for the backward A* search, which takes segmentations off its heap best first.  Scores are whole millionths, so
both directions add up alike.

Where no piece spans a boundary the lattice falls apart: before a blank that follows another character (if no piece has
a blank inside) and beside line ends (if no piece has one).  Each chunk between such boundaries is solved once for all its occurrences in a
worker (a bounded table): its best segmentation, and how much the second best loses, which is the least loss of a different edge into a node of the
best path.  A text's best segmentation is that of its chunks; any of its N best changes only chunks among the N - 1 with the
least first losses, so A* runs for those alone and their lists are merged.  The result is the N best of the whole text,
ties going to the earlier chunk, then to the one found first.

``encode`` gives the N best in short: the ids of the best, and each way as its score and the stretches of those ids that it changes;
``segmentations`` makes whole ids of that.

Decoding concatenates pieces, reads byte pieces as UTF-8, turns the blank sign into a space and drops the one that
encoding put in front, as the library does.

Null and empty texts have no ids, score 0 and one segmentation.  A text of any length is encoded whole.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import portions, release, ship, unused

NBEST = 4
UNKNOWN = 10
UNIT = 1_000_000
BLANK = "▁"
#: Chunks that a worker holds at once.
CACHE = 400_000
#: Bits of a key that tell at once that most strings are no piece.
LEAD = 18
#: Added to ranks of a merge model before the logarithm.
ZIPF = 100
_NAMES = ["ids", "score", "nbest", "n_ids", "ids_hash", "round_trip"]
SCHEMA = "ids array<int>, score double, nbest array<struct<score: double, changes: array<struct<at: int, size: int, ids: array<int>>>>>, n_ids long, ids_hash long, round_trip boolean"
_CHANGES = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))]))
_TYPES = [pa.list_(pa.int32()), pa.float64(), pa.list_(pa.struct([("score", pa.float64()), ("changes", _CHANGES)])), pa.int64(), pa.int64(), pa.bool_()]
_FAR = np.iinfo(np.int64).max


class Pieces:
    """A model's pieces and the solved chunks of a worker."""

    def __init__(self, path: str, nbest: int = NBEST):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, size = self.library, self.library.vocab_size()
        self.nbest = nbest
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_id = sp.unk_id()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.silent = {i for i in range(size) if sp.is_control(i)}
        value = {i: sp.get_score(i) for i in plain}
        if plain and len(set(value.values())) > 0.9 * len(plain) and all(x <= 0 and x == int(x) for x in value.values()):  # ranks
            value = {i: -math.log(ZIPF - x) for i, x in value.items()}
        self.score = {self.text[i]: (round(value[i] * UNIT), i) for i in plain}
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.lowest = min((s for s, _ in self.score.values()), default=0) - UNKNOWN * UNIT
        held = {c for p in self.score for c in p}
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            self.chunks = regex.compile("(?s).+")  # a blank can be anywhere in a piece, so nothing falls apart
        else:
            self.chunks = regex.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.by_line = "\n" not in held
        self.ascii_text = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else "" if i in self.silent else t for i, t in enumerate(self.text)]
        self.high_byte = np.array([self.byte_of.get(i, 0) >= 128 for i in range(size)])
        self.longest = max(map(len, self.score), default=1)
        self.keys: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # of each length: keys in order, scores, ids, and which leading bits keys have
        for n in range(1, self.longest + 1):
            some = [x for x in self.score if len(x) == n]
            key = _keys(np.array([[ord(c) for c in x] for x in some], np.uint64).reshape(-1, n))
            order = np.argsort(key)
            lead = np.zeros(1 << LEAD, bool)
            lead[key >> np.uint64(64 - LEAD)] = True
            self.keys.append((key[order], np.array([self.score[x][0] for x in some], np.int64)[order], np.array([self.score[x][1] for x in some], np.int64)[order], lead))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.best, self.loss, self.first, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(8192, np.int32), 0
        self.lists: dict[str, list[tuple[int, list[int]]]] = {}

    def edges(self, chunk: str, i: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """End, score and ids of each edge from node i."""
        alone = False
        for j in range(i + 1, len(chunk) + 1):
            piece = chunk[i:j]
            if piece not in self.prefixes:
                break
            found = self.score.get(piece)
            if found:
                alone |= j == i + 1
                yield j, found[0], (found[1],)
        if not alone:
            yield i + 1, self.lowest, tuple(self.bytes.get(b, self.unknown_id) for b in chunk[i].encode("utf-8", "surrogatepass"))

    def forward(self, chunk: str) -> tuple[list[int], list[int], list[tuple]]:
        """Best value at each node, the second best among its incoming edges, and the best edge (longest first among equals)."""
        n = len(chunk)
        best: list = [0] + [None] * n
        second: list = [None] * (n + 1)
        back: list = [None] * (n + 1)
        score, prefixes = self.score.get, self.prefixes
        for i in range(n):
            here, alone = best[i], False
            for j in range(i + 1, n + 1):
                piece = chunk[i:j]
                found = score(piece)
                if found:
                    alone |= j == i + 1
                    value = here + found[0]
                    if best[j] is None:
                        best[j], back[j] = value, (i, found[1])
                    elif value > best[j]:
                        best[j], second[j], back[j] = value, best[j], (i, found[1])
                    elif second[j] is None or value > second[j]:
                        second[j] = value
                elif piece not in prefixes:
                    break
            if not alone:
                value, j = here + self.lowest, i + 1
                if best[j] is None:
                    best[j], back[j] = value, (i, None)
                elif value > best[j]:
                    best[j], second[j], back[j] = value, best[j], (i, None)
                elif second[j] is None or value > second[j]:
                    second[j] = value
        return best, second, back

    def search(self, chunk: str, most: int) -> list[tuple[int, list[int]]]:
        """The ``most`` best segmentations of a chunk, best first: backward A* under the forward scores."""
        best = self.forward(chunk)[0]
        into: list[list] = [[] for _ in range(len(chunk) + 1)]
        for i in range(len(chunk)):
            for j, score, ids in self.edges(chunk, i):
                into[j].append((i, score, ids))
        found, order = [], 0
        heap: list = [(-best[-1], len(chunk), 0, 0, None)]
        while heap and len(found) < most:
            _, node, _, done, path = heapq.heappop(heap)
            if node == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((done, ids))
                continue
            for i, score, ids in into[node]:
                order += 1
                heapq.heappush(heap, (-(best[i] + score + done), i, order, done + score, (ids, path)))
        return found

    def solve(self, chunk: str) -> int:
        """The number of a chunk that was not met yet."""
        best, second, back = self.forward(chunk)
        ids: list[int] = []
        loss, node = _FAR, len(chunk)
        while node:
            if second[node] is not None:
                loss = min(loss, best[node] - second[node])
            i, one = back[node]
            ids += [one] if one is not None else [self.bytes.get(b, self.unknown_id) for b in reversed(chunk[i].encode("utf-8", "surrogatepass"))]
            node = i
        k = len(self.at)
        if k == len(self.best):
            self.best, self.loss, self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.best, self.loss, self.first, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids[::-1]
        self.best[k], self.loss[k], self.first[k], self.length[k] = best[-1], loss, self.used, len(ids)
        self.used += len(ids)
        self.at[chunk] = k
        return k

    def solve_many(self, chunks: list[str]) -> None:
        """As solve(), for many chunks at once, a column of all lattices at a time."""
        groups: dict[int, list[str]] = {}
        for c in chunks:
            n = len(c)
            groups.setdefault(8 if n <= 8 else 16 if n <= 16 else 32 if n <= 32 else 0, []).append(c)
        for width, some in groups.items():
            if not width:
                for c in some:
                    self.solve(c)
                continue
            for k in range(0, len(some), 20_000):
                self._solve_block(some[k : k + 20_000], width)

    def _solve_block(self, chunks: list[str], width: int) -> None:
        n = len(chunks)
        chars = np.array(chunks, f"<U{width}").view(np.uint32).reshape(n, width).T.astype(np.uint64)
        size = np.fromiter(map(len, chunks), np.int64, n)
        low = np.int64(-(1 << 60))
        best, second = np.full((width + 1, n), low), np.full((width + 1, n), low)
        back, via = np.zeros((width + 1, n), np.int8), np.full((width + 1, n), -1, np.int32)
        best[0] = 0
        key = np.zeros((width, n), np.uint64)
        edges: list[list] = [[] for _ in range(width + 1)]  # of each end: length, chunks, scores, ids
        alone = np.zeros((width, n), bool)
        for length in range(1, min(self.longest, width) + 1):
            last = width - length + 1
            key = _next(key[:last], chars[length - 1 :])
            keys, scores, ids, lead = self.keys[length - 1]
            if not len(keys):
                continue
            i, chunk = np.nonzero(lead[key >> np.uint64(64 - LEAD)])
            wanted = key[i, chunk]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            i, chunk, at = i[hit], chunk[hit], at[hit]
            if length == 1:
                alone[i, chunk] = True
            ends = np.searchsorted(i, np.arange(last + 1))
            for k in np.flatnonzero(np.diff(ends)).tolist():
                some = slice(ends[k], ends[k + 1])
                edges[k + length].append((length, chunk[some], scores[at[some]], ids[at[some]]))
        for j in range(1, width + 1):
            other = np.flatnonzero(~alone[j - 1] & (size >= j))
            for length, chunk, score, ids in [*reversed(edges[j]), (1, other, np.full(len(other), self.lowest), np.full(len(other), -1))]:  # longest first, so that ties stay with it
                value, had = best[j - length, chunk] + score, best[j, chunk]
                more = value > had
                second[j, chunk] = np.where(more, had, np.maximum(second[j, chunk], value))
                better = chunk[more]
                best[j, better], back[j, better], via[j, better] = value[more], length, ids[more]
        rows, node, loss = np.arange(n), size.copy(), np.full(n, _FAR)
        found = np.full((width, n), -2, np.int32)
        for step in range(width):
            live = node > 0
            if not live.any():
                break
            gap = np.where(second[node, rows] > low // 2, best[node, rows] - second[node, rows], _FAR)
            loss = np.where(live, np.minimum(loss, gap), loss)
            start = node - back[node, rows]
            found[step] = np.where(live, np.where(via[node, rows] >= 0, via[node, rows], -3 - chars[np.maximum(start, 0), rows].astype(np.int64)), -2)
            node = np.where(live, start, node)
        flat = found[::-1].T
        total = best[size, rows]
        odd = (flat < -2).any(1)  # characters as bytes
        plain = np.flatnonzero(~odd).tolist()
        lengths = (flat >= 0).sum(1)
        base = len(self.at)
        while base + n > len(self.best):
            self.best, self.loss, self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.best, self.loss, self.first, self.length))
        ids = flat[plain]
        ids = ids[ids >= 0]
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        to = slice(base, base + len(plain))
        self.best[to], self.loss[to], self.length[to] = total[plain], loss[plain], lengths[plain]
        self.first[to] = self.used + np.cumsum(lengths[plain]) - lengths[plain]
        self.used += len(ids)
        self.at.update(zip([chunks[k] for k in plain], range(base, base + len(plain)), strict=True))
        for k in np.flatnonzero(odd).tolist():
            self.solve(chunks[k])

    def split(self, text: str) -> list[str]:
        """The chunks of a text, in order."""
        if not text:
            return []
        text = self.library.normalize(text).replace(" ", BLANK)
        if not self.by_line or "\n" not in text:
            return self.chunks.findall(text)
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            out += self.chunks.findall(line)
        return out

    def encode(self, text: str | None) -> tuple[np.ndarray, int, list[tuple[int, dict[int, list[int]]]], list[str], np.ndarray]:
        """As encode_many() for one text."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[tuple[np.ndarray, int, list[tuple[int, dict[int, list[int]]]], list[str], np.ndarray]]:
        """For each text: best ids, best score, N best as (loss, changed chunks), the chunks and their numbers."""
        if len(self.at) > CACHE:
            self.clear()
        split = [self.split(t or "") for t in texts]
        at = self.at
        self.solve_many(list({c for chunks in split for c in chunks if c not in at}))
        return [self._joined(chunks) for chunks in split]

    def _joined(self, chunks: list[str]) -> tuple:
        code = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        length = self.length[code]
        total = int(length.sum())
        ids = self.pool[np.repeat(self.first[code] - np.cumsum(length) + length, length) + np.arange(total)] if total else np.zeros(0, np.int32)
        ways: list[tuple[int, dict[int, list[int]]]] = [(0, {})]
        loss = self.loss[code]
        if self.nbest < 2:
            few = np.zeros(0, np.int64)
        elif len(loss) < self.nbest:
            few = np.arange(len(loss))
        else:
            few = np.flatnonzero(loss <= np.partition(loss, self.nbest - 2)[self.nbest - 2])
        few = few[np.argsort(loss[few], kind="stable")][: self.nbest - 1]
        for place in few.tolist():
            if loss[place] == _FAR:
                break
            other = [(0, None), *self.alternatives(chunks[place])]
            ways = heapq.nsmallest(self.nbest, [(a + b, w if x is None else w | {place: x}) for a, w in ways for b, x in other], key=lambda x: x[0])
        return ids, int(self.best[code].sum()), ways, chunks, code

    def alternatives(self, chunk: str) -> list[tuple[int, list[int]]]:
        """Losses and ids of the second best and later ways of a chunk."""
        if chunk not in self.lists:
            if len(self.lists) > CACHE // 20:
                self.lists.clear()
            k = self.at[chunk]
            best = self.pool[self.first[k] : self.first[k] + self.length[k]].tolist()
            found = self.search(chunk, self.nbest)
            self.lists[chunk] = [(found[0][0] - s, ids) for s, ids in found if ids != best][: self.nbest - 1]  # among equals the best may be found later
        return self.lists[chunk]

    def changes(self, found: tuple) -> list[dict]:
        """Score of each of the N best of ``encode``, and what it changes: where in the best ids, how many of them, and the ids instead."""
        _, best, ways, _, code = found
        after = np.cumsum(self.length[code]) if len(ways) > 1 else None
        return [
            {"score": (best - loss) / UNIT, "changes": [{"at": int(after[p] - self.length[code[p]]), "size": int(self.length[code[p]]), "ids": changed[p]} for p in sorted(changed)]}
            for loss, changed in ways
        ]

    def nbest_ids(self, text: str | None) -> list[tuple[float, list[int]]]:
        """Score and ids of each of the N best segmentations."""
        _, best, ways, chunks, code = self.encode(text)
        out = []
        for loss, changed in ways:
            ids: list[int] = []
            for place, k in enumerate(code.tolist()):
                ids += changed[place] if place in changed else self.pool[self.first[k] : self.first[k] + self.length[k]].tolist()
            out.append(((best - loss) / UNIT, ids))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        if not self.high_byte[ids].any():
            out = "".join(map(self.ascii_text.__getitem__, ids.tolist())).replace(BLANK, " ")
            return out[1:] if out.startswith(" ") else out
        parts: list[str] = []
        raw = bytearray()
        byte_of, text, silent = self.byte_of, self.text, self.silent
        for i in ids.tolist():
            b = byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in silent:
                parts.append(text[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        out = "".join(parts).replace(BLANK, " ")
        return out[1:] if out.startswith(" ") else out


def _next(key: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Keys of strings one character longer."""
    return (key ^ chars) * np.uint64(0x9E3779B97F4A7C15) + (key >> np.uint64(29))


def _keys(chars: np.ndarray) -> np.ndarray:
    key = np.zeros(len(chars), np.uint64)
    for k in range(chars.shape[1]):
        key = _next(key, chars[:, k])
    return key


@functools.lru_cache(maxsize=2)
def pieces(path: str, nbest: int) -> Pieces:
    return Pieces(path, nbest)


def encode(docs: DataFrame, text_col: str = "text", model: str | None = None, nbest: int = NBEST, keep: list[str | Column] | None = None) -> DataFrame:
    """The kept columns of every row with ids, score, the N best (score and changes to ids), n_ids, a hash of the ids, and whether decoding gives the text back."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    ship(docs.sparkSession)
    names = [f"_kept{k}" for k in range(len(keep or ()))]
    kept = [F.col(c) if isinstance(c, str) else c for c in keep or ()]
    rows = docs.select(*[c.alias(n) for c, n in zip(kept, names, strict=True)], F.col(text_col).cast("string").alias("_text"))
    back = docs.select(*kept).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = pieces(path, nbest)
        try:
            for batch in batches:
                for part in portions(batch, len(names)):
                    yield encoded(solver, part)
        finally:
            solver.clear()  # the worker lives on for other tasks
            release()

    def encoded(solver: Pieces, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(names)).to_pylist()
        ids, scores, ways, sums, trips = [], [], [], [], []
        for text, found in zip(texts, solver.encode_many(texts), strict=True):
            ids.append(found[0])
            scores.append(found[1] / UNIT)
            ways.append(solver.changes(found))
            sums.append(xxhash.xxh64_intdigest(found[0].tobytes()) - (1 << 63))
            trips.append(solver.decode(found[0]) == (text or "").replace(BLANK, " "))
        sizes = [len(x) for x in ids]
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
        columns = [listed, *(pa.array(c, t) for c, t in zip((scores, ways, sizes, sums, trips), _TYPES[1:], strict=True))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, *_NAMES])

    schema = ", ".join([*(f"{n} {dict(rows.dtypes)[n]}" for n in names), SCHEMA])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(b) for n, b in zip(names, back, strict=True)], *_NAMES)


def segmentations(encoded: DataFrame, rank: str = "rank") -> DataFrame:
    """A row for each of the N best of every row of ``encode``: ``rank`` from 1, its score and its whole ids, beside the other columns."""
    others = [c for c in encoded.columns if c not in _NAMES]
    (way,) = unused(encoded, "_way")
    whole = f"aggregate(reverse(array_sort({way}.changes)), ids, (acc, c) -> concat(slice(acc, 1, c.at), c.ids, slice(acc, c.at + c.size + 1, size(acc))))"
    return encoded.select(*others, "ids", F.posexplode("nbest").alias(rank, way)).select(*others, (F.col(rank) + 1).alias(rank), f"{way}.score", F.expr(whole).alias("ids"))


def decode(encoded: DataFrame, ids_col: str = "ids", into: str = "text", model: str | None = None) -> DataFrame:
    """The rows with the text of their ids; null ids give null."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        solver = pieces(path, NBEST)
        return pd.Series([None if x is None else solver.decode(np.asarray(x, np.int64)) for x in ids], dtype=object)

    return encoded.withColumn(into, text_of(F.col(ids_col)))
