"""Token counts from pre-token frequencies, without materialising the ids of a text.

A byte-level BPE never merges across pre-tokens, so the number of tokens of a text is the sum over its distinct
pre-tokens of frequency times pieces.  Each block of texts (an Arrow batch) makes its pre-token frequencies; the distinct
pre-tokens that the worker has not met are counted once, by the library's model, into a dictionary; the frequencies are
joined to the dictionary and summed.  Frequencies are of blank-delimited runs of pre-tokens ("word," is two) where that
is the same, which is what makes the first step fast.

The join is per block rather than over the corpus on purpose.  A corpus-wide join moves one row for each (document,
distinct pre-token), which is more bytes than the texts have, and its key for a frequent word holds a row of nearly
every document; the block join moves nothing and has no hot key.  The dictionary is bounded (``CACHE``).

Null and empty texts have 0 tokens.  A text of any length is read whole.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from wayfold.llm.common import id_and_text, portions, release, ship

#: Distinct pre-tokens and runs of them whose counts a worker holds between blocks.
CACHE = 500_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_SPLIT = regex.compile(public_tokenizers.PATTERN)
#: Texts of these characters are split by the pattern above; for others, whose classes depend on the Unicode version, the library's own splitter is asked.
_MET = regex.compile(r"\s\s")
_PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*+")


class _Chunks(dict):
    """Pieces of each blank-delimited run of pre-tokens; a run not met yet is split and its pre-tokens looked up."""

    def __init__(self, lead: str, count: Callable[[str], int]):
        super().__init__()
        self.lead, self.count = lead, count

    def __missing__(self, chunk: str) -> int:
        text = self.lead + chunk
        if chunk.isalpha():
            n = self.count(text)
        elif chunk[:-1].isalpha() and chunk[-1] in ".,":
            n = self.count(text[:-1]) + self.count(chunk[-1])
        else:
            n = sum(map(self.count, _SPLIT.findall(text)))
        self[chunk] = n
        return n


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceCounter:
    """Counts for one vocabulary file; a worker keeps one for each path."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.counts: dict[str, int] = {}
        self.first, self.rest = _Chunks("", self.pre_token), _Chunks(" ", self.pre_token)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None

    def pre_token(self, word: str) -> int:
        """Pieces of one pre-token, counted when it is first met."""
        n = self.counts.get(word)
        if n is None:
            n = self.counts[word] = len(self.pieces(word.encode().decode("latin-1").translate(self.letters)))
        return n

    def run(self, text: str) -> int:
        """Tokens of a text without special strings, by its pre-token frequencies."""
        words = _SPLIT.findall(text) if _PLAIN.fullmatch(text) else [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return sum(map(self.pre_token, words))

    def part(self, text: str) -> int:
        """As run(); where no two spaces meet, a pre-token ends before every blank and beside every line end, so the text may be cut there first."""
        if _MET.search(text) or not _PLAIN.fullmatch(text):
            return self.run(text)
        lines = text.split("\n")
        firsts: list[str] = []
        rests: list[str] = []
        for line in lines:
            first, *rest = line.split(" ")
            firsts.append(first)
            rests += rest
        total = (len(lines) - 1) * self.pre_token("\n")
        for chunks, words in ((self.first, Counter(firsts)), (self.rest, Counter(rests))):
            total += sum(map(int.__mul__, map(chunks.__getitem__, words), words.values()))
        return total

    def clear(self) -> None:
        for held in (self.counts, self.first, self.rest):
            held.clear()

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.counts) + len(self.first) + len(self.rest) > CACHE:
            self.clear()
        found = []
        for text in texts:
            if text and self.special and self.special.search(text):
                parts = self.special.split(text)
                found.append(len(parts) - 1 + sum(map(self.part, parts)))
            else:
                found.append(self.part(text) if text else 0)
        return found


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        try:
            for part in (x for batch in batches for x in portions(batch, 1)):
                texts = part.column(1).to_pylist()
                tokens = counts.count(texts)
                sizes = [len((t or "").encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        finally:
            counts.clear()  # the worker lives on for other tasks
            release()

    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
