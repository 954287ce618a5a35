"""Session helpers."""

from __future__ import annotations

import os
import secrets
import tempfile
import zipfile

from pyspark import TaskContext
from pyspark.sql import SparkSession

_shipped: set[str] = set()
SEED = "PALIMPSEST_SEED"
_own_seed = secrets.randbits(64)


def hash_seed() -> int:
    """Secret of this driver's hashes; the same on its workers, whose plans were made after share_seed()."""
    if TaskContext.get() is None:
        return _own_seed
    return int(os.environ[SEED])


def share_seed(spark: SparkSession) -> None:
    """Hand the hash seed to the Python workers of plans made from now on."""
    spark.sparkContext.environment[SEED] = str(_own_seed)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="palimpsest-py-"), "palimpsest.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("palimpsest", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def with_package(query):
    """query(spark, sf_dir) that first ships the package."""

    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run
