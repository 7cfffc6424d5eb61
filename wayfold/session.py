"""A session with the settings that the engine is written for."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession

_PACKAGE = __name__.split(".")[0]

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; what a cluster's own configuration says about sizes and folders is left to it."""
    builder = SparkSession.builder.appName("wayfold")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that functions pickled by name load there."""
    sc = spark.sparkContext
    if getattr(SparkContext, "_wayfold_shipped", None) == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # on the driver, which serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{_PACKAGE}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for inside, _, names in os.walk(os.path.join(root, _PACKAGE)):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(inside, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    SparkContext._wayfold_shipped = sc.applicationId


def shipping(function: Callable[..., Column]) -> Callable[..., Column]:
    """A maker of Columns over Python functions that sends this package to the executors of the session it is used in."""

    @functools.wraps(function)
    def call(*columns: Column, **options: object) -> Column:
        active = SparkSession.getActiveSession()
        if active is not None:
            ship(active)
        return function(*columns, **options)

    return call
