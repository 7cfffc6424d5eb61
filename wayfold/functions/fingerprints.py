"""Fingerprints of drafts and selections: SHA-256 over JSON in one fixed form, so that only what matters changes them."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wayfold.session import shipping


def canonical(text: str | None, without: tuple[str, ...] = (), ascii_only: bool = False) -> str | None:
    """JSON with sorted keys and no blanks, without some fields of the outermost object; the order of lists stays.  Null for what is no JSON."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if value is None:
        return None
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if k not in without}
    return json.dumps(value, ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":"))


@shipping
def canonical_json(text: Column, without: tuple[str, ...] = ()) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(t, without))

    return run(text)


def draft_fingerprint(text: Column, presentation: tuple[str, ...] = ("manualSelection", "manualSelectionN13Fingerprint", "presentationType")) -> Column:
    """Of a draft's JSON: what only presents it or was chosen by hand does not count, the order of lists does."""
    return F.sha2(canonical_json(text, presentation), 256)


def content_json_id(text: Column, size: int = 20, prefix: str = "") -> Column:
    """A prefix of the hash over JSON in the fixed form."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(text), 256), 1, size))


def selection_fingerprint(include: Column, exclude: Column) -> Column:
    """Of what was chosen by hand: neither order nor repetition counts; null lists are empty.  Ids are plain ASCII text."""
    listed = lambda c: F.to_json(F.array_sort(F.array_distinct(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")))))
    return F.sha2(F.concat(F.lit('{"exclude":'), listed(exclude), F.lit(',"include":'), listed(include), F.lit("}")), 256)


def selection_hash(include: list[str], exclude: list[str]) -> str:
    """The same of plain lists."""
    return hashlib.sha256(json.dumps({"include": sorted(set(include)), "exclude": sorted(set(exclude))}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
