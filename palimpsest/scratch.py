"""Intermediate tables in the shared checkpoint folder, to cut lineage.

The folder is spark.checkpoint.dir; only where the session has none (as in
tests on one machine) a temporary folder is set.  Tables are Parquet, so a lost
executor costs a reread, never a recomputation of the steps before.

Shuffle files of a write are removed when the table is complete: nothing reads
them again.  A table belongs to the ``owned`` block it was made in; ``drop``
deletes single tables whose last reader is done, ``release`` an owner's rest.
Lazy results may still read the tables of their call, so those stay until their
owner is released.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_owner: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owner", default=None)


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


@contextlib.contextmanager
def owned(tables: list[str]):
    """Tables made inside are noted in ``tables``, to be released by whoever holds the list."""
    token = _owner.set(tables)
    try:
        yield tables
    finally:
        _owner.reset(token)


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of executions inside are removed at their end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there."""
    spark = df.sparkSession
    at = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(at)
    if (tables := _owner.get()) is not None:
        tables.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch_path = at
    return out


#: Tables of rounds that a plan reads one by one; more are merged.
MANY_TABLES = 8
#: File size up to which rounds broadcast a table; as rows on the driver it is many times as large.
BROADCAST_BYTES = 1 << 20


@contextlib.contextmanager
def lean(spark: SparkSession):
    """For rounds of joins, whose tables are many: what is executed inside broadcasts small tables only."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST_BYTES:
        spark.conf.set(key, BROADCAST_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def collected(tables: list[DataFrame], name: str, all: bool = False) -> list[DataFrame]:
    """The tables of rounds; merged to one, and deleted, where they are more than MANY_TABLES (or any two).

    A plan with a scan for each round grows with the rounds, and the driver keeps the plans of past executions.
    """
    if len(tables) <= (1 if all else MANY_TABLES):
        return tables
    one = table(union(tables), name)
    drop(*tables)
    return [one]


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of table() that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


def release(spark: SparkSession, tables: list[str]) -> None:
    """Delete an owner's tables; for callers whose results are already written."""
    while tables:
        _delete(spark, tables.pop())
