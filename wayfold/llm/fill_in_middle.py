"""Fill-in-middle transformation: a text is cut at two code points and written with its middle last.

Code points come from the ``tokenizers`` library: a Split pre-tokenizer with an isolated match for each code point, which needs no
training.  The offsets that it gives are the text's units: their number is n, and the offset of a rank is where a slice starts.  One
offset costs about 2 microseconds, so a worker asks for those of a blank-delimited run of up to ``RUN`` characters once and keeps how
many there are while its bounded dictionary lasts; longer runs are asked in blocks.  A match never reaches over such a border, so the
arrays of the runs, one behind the other, are the array of the text.

Whether and how a text is cut depends on the id alone.  With a mark inside it a text could not be restored, so it stays plain, and so
does an empty one.  Null texts are empty; a null id hashes as no digits.  A text of any length is cut whole; repeated rows give
repeated rows; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from wayfold.llm.common import id_and_text, portions, release, ship

MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are cut, and of 100 that are cut so many have their suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Longest run whose number of units is kept; runs kept by a worker; characters of a longer run asked at once.
RUN, CACHE, BLOCK = 64, 300_000, 16_384
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Units:
    """Offsets of code points, by the library."""

    def __init__(self) -> None:
        self.split = Split(Regex("(?m:.)"), "isolated")
        self.counts: dict[str, int] = {}

    def offsets(self, text: str) -> list[int]:
        """Where each unit starts."""
        out: list[int] = []
        for at in range(0, len(text), BLOCK):
            out += [at + start for _, (start, _) in self.split.pre_tokenize_str(text[at : at + BLOCK])]
        return out

    def count(self, run: str) -> int:
        n = self.counts.get(run)
        if n is None:
            if len(run) <= RUN:
                n = self.counts[run] = len(self.offsets(run))
            else:
                n = sum(len(self.offsets(run[at : at + BLOCK])) for at in range(0, len(run), BLOCK))
        return n

    def slices(self, text: str, ranks: list[int]) -> tuple[int, list[int]]:
        """The number of units, and where the units of ascending ranks start; the ranks are functions of that number (rank % (n + 1))."""
        if len(self.counts) > CACHE:
            self.counts.clear()
        runs = text.split(" ")
        sizes = list(map(self.count, runs))
        n = sum(sizes) + len(runs) - 1
        wanted = sorted(r % (n + 1) for r in ranks)
        found, before, k, start = [], 0, 0, 0
        for rank in wanted:
            while k < len(runs) and rank > before + sizes[k]:  # the rank lies behind this run and its blank
                before += sizes[k] + 1
                start += len(runs[k]) + 1
                k += 1
            inside = rank - before
            found.append(start + (len(runs[k]) if inside == sizes[k] else self.offsets(runs[k])[inside]))
        return n, found


@functools.lru_cache(maxsize=1)
def units() -> Units:
    return Units()


def choices(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(doc_id: int | None, text: str, seed: int, rate: int, suffix_first: int, marks: tuple[str, str, str], of: Units) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the output of one text."""
    one, two, how, order = choices(doc_id, seed)
    n, (a, b) = of.slices(text, [one, two])
    if not text or how % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = units()
        try:
            for part in (x for batch in batches for x in portions(batch, 1)):
                rows = [(i, *transform(i, t or "", seed, rate, suffix_first, marks, of)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        finally:
            of.counts.clear()  # the worker lives on for other tasks
            release()

    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of; no part has a mark inside, so the first of each mark is the one that was written."""
    p, s, m = (F.instr(output, x) for x in marks)
    np, ns, nm = (F.lit(len(x)) for x in marks)
    middle = output.substr(m + nm, F.length(output))
    psm = F.concat(output.substr(np + 1, s - np - 1), middle, output.substr(s + ns, m - s - ns))
    spm = F.concat(output.substr(p + np, m - p - np), middle, output.substr(ns + 1, p - ns - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
