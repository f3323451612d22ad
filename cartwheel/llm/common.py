"""Helpers shared by the operators: table readers, shared scratch tables, text expressions."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.session import ensure_checkpoint_dir

#: A word of a text: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` (shared by driver and executors on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage like a checkpoint (a lost executor loses nothing) and gives the
    optimizer the real size, so a later join broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand whole texts to Python at most ``rows`` at a time; both sides hold a batch in memory."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to write."""
    return df.drop(*names)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
