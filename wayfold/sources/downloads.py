"""Downloaded files judged by what they hold: web pages, broken JSON and wrong containers are told from the data that was expected.

Files come as Spark's ``binaryFile`` rows.  Each is judged by its own bytes in one small step; nothing is written or kept beside it.
"""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.session import ship

FORMATS = ("geojson", "geopackage", "zip")
_SQLITE = b"SQLite format 3\0"


def layers_of(content: bytes) -> list[str]:
    """Names of a package's layers, from its own catalogue."""
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(content)
        return [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]
    except sqlite3.Error:
        return []
    finally:
        con.close()


def problem(content: bytes | None, expected: str | None, content_type: str | None = None, status: int | None = None) -> tuple[str | None, list[str]]:
    """What is wrong with a file, or null, and its layers if it is a package."""
    if status is not None and not 200 <= status < 300:
        return "not a success status", []
    if content is None:
        return "no content", []
    if content[:512].lstrip().lower().startswith((b"<!doctype html", b"<html")) or "text/html" in (content_type or "").lower():
        return "an HTML document", []
    if expected == "geojson":
        try:
            document = json.loads(content.decode("utf-8"))
        except (UnicodeDecodeError, json.JSONDecodeError, RecursionError):
            return "not valid JSON", []
        whole = isinstance(document, dict) and document.get("type") == "FeatureCollection" and isinstance(document.get("features"), list)
        return (None if whole else "not a FeatureCollection"), []
    if expected == "geopackage":
        if not content.startswith(_SQLITE):
            return "no SQLite header", []
        found = layers_of(content)
        return (None if found else "no readable layers"), found
    if expected == "zip":
        return (None if zipfile.is_zipfile(io.BytesIO(content)) else "not a ZIP archive"), []
    return "an unknown format", []


def expected_of(path: Column) -> Column:
    """The format that a path's ending promises, or null."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ending.isin("geojson", "json"), "geojson").when(ending == "gpkg", "geopackage").when(ending == "zip", "zip")


def judged(files: DataFrame, content: str = "content", expected: Column | None = None, content_type: Column | None = None, status: Column | None = None, path: str = "path") -> DataFrame:
    """path, problem (null for a sound file) and layers of every file."""
    none = F.lit(None)
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content"), (expected if expected is not None else expected_of(F.col(path))).alias("expected"), (content_type if content_type is not None else none.cast("string")).alias("kind"), (status if status is not None else none.cast("int")).alias("status"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [problem(None if c is None else bytes(c), e, k, None if pd.isna(s) else int(s)) for c, e, k, s in zip(frame["content"], frame["expected"], frame["kind"], frame["status"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "problem": [p for p, _ in found], "layers": [names for _, names in found]})

    ship(files.sparkSession)
    return rows.mapInPandas(run, "path string, problem string, layers array<string>")


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path and content of files, by Spark's own source, so any store that Spark reads will do.  That source leaves files without a byte out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def member(content: bytes | None, wanted: str | None = None, ending: str = ".gpkg") -> tuple[str | None, str | None, list[str]]:
    """The archive member to take, or why there is none, and all members: the wanted one, else the only one with the ending.

    A name that would leave the folder it is unpacked to is refused.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            names = [i.filename for i in archive.infolist() if not i.is_dir()]
    except zipfile.BadZipFile:
        return None, "not a ZIP archive", []
    some = [n for n in names if n == wanted] if wanted else [n for n in names if n.lower().endswith(ending)]
    if len(some) != 1:
        return None, f"{len(some)} members fit", names
    if some[0].startswith(("/", "\\")) or ".." in some[0].replace("\\", "/").split("/") or ":" in some[0].split("/")[0]:
        return None, "an unsafe member name", names
    return some[0], None, names


def extracted(files: DataFrame, wanted: str | None = None, ending: str = ".gpkg") -> DataFrame:
    """path, member, problem, content (of the member) of every archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                raw = None if raw is None else bytes(raw)
                name, wrong, _ = member(raw, wanted, ending)
                out.append((path, name, wrong, zipfile.ZipFile(io.BytesIO(raw)).read(name) if name else None))
            yield pd.DataFrame(out, columns=["path", "member", "problem", "content"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, member string, problem string, content binary")
