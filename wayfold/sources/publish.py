"""Publishing by rename: readers never see part of a folder; and project bundles read back."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.sources.features import read_geojson_lines

PROJECT_ID = re.compile(r"[a-z0-9][a-z0-9-]*")


def publish(spark: SparkSession, path: str, write: Callable[[str], object]) -> None:
    """Have a folder written beside the path, then renamed to it; if writing fails nothing changes.

    An older folder is moved aside first and deleted last, so it comes back if the rename fails.  Between the two renames, for an instant, readers find no
    folder; on an object store, where a rename copies, for longer.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(conf)
    mark = uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    try:
        write(new)
        there = fs.exists(place(path))
        if there and not fs.rename(place(path), place(old)):
            raise OSError(f"{path} could not be moved aside")
        if not fs.rename(place(new), place(path)):
            if there:
                fs.rename(place(old), place(path))
            raise OSError(f"{path} could not be published")
        if there:
            fs.delete(place(old), True)
    finally:
        fs.delete(place(new), True)


def load_bundle(spark: SparkSession, root: str, project: str, families: tuple[str, ...]) -> dict[str, DataFrame]:
    """The manifest, search entries and every layer of a project's bundle; an id that could leave the folder is an error."""
    if not PROJECT_ID.fullmatch(project):
        raise ValueError(f"unsafe project id {project!r}")
    folder = f"{root}/{project}"
    out = {"manifest": spark.read.schema("family string, n long, n_with_geometry long").json(f"{folder}/manifest")}
    out["search"] = spark.read.schema("id string, type string, name string, aliases array<string>, terms array<string>").json(f"{folder}/search")
    return out | {f: read_geojson_lines(spark, f"{folder}/{f}") for f in families}
