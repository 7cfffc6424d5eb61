"""Text normalisation and token predicates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wayfold.session import shipping

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KANJI_DIGITS = "〇一二三四五六七八九"


@shipping
@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; the JVM functions have none."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@shipping
@F.pandas_udf(StringType())
def search_key(text: pd.Series) -> pd.Series:
    """The form in which names are searched: NFKC, lower case, no blanks or middle dots, block numbers in digits, road prefixes and suffixes gone."""
    return text.map(lambda t: None if t is None else search_form(t))


def search_form(text: str) -> str:
    text = re.sub(r"[\s・]", "", unicodedata.normalize("NFKC", text).lower())
    text = re.sub(f"[{KANJI_DIGITS}](?=丁目)", lambda m: str(KANJI_DIGITS.index(m[0])), text)
    text = re.sub(r"^(r|国道)(?=\d)", "", text)
    return re.sub("号$", "", text)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def present(text: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*map(present, columns))


def tokens(text: Column, separator: str = ";") -> Column:
    """Trimmed tokens without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda t: t != "")


def has_token(text: Column, wanted: Column, separator: str = ";") -> Column:
    """Whether a whole token is one of the wanted ones; false for null."""
    return F.coalesce(F.arrays_overlap(tokens(text, separator), wanted), F.lit(False))


def hstore(text: Column) -> Column:
    """A map from ``"key"=>"value"`` pairs; the last of equal keys wins."""
    pattern = '"((?:[^"\\\\]|\\\\.)*)"=>"((?:[^"\\\\]|\\\\.)*)"'
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def percent_encoded(text: Column, safe: str = ":") -> Column:
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in safe:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def joined_key(*columns: Column) -> Column:
    """Values with their lengths, so that no two lists give one key."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("~")) for c in columns])


def content_id(*columns: Column, size: int = 24, prefix: str = "") -> Column:
    """A prefix of the SHA-256 over the values, null-separated."""
    raw = F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.concat(F.lit(prefix), F.substring(F.sha2(raw, 256), 1, size))
