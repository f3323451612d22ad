"""Bucketed tables: rows of a key lie in one bucket, so joins and aggregates on it plan no exchange.

A table is a folder of Parquet files and a one-row layout file beside it, both in shared
storage; any session can declare it in its catalog again from these two.  A bucket is read
by one task.  Where one key holds so many rows that its bucket stands out, the table is
declared without buckets: its files are then split among tasks as usual, and Spark
shuffles partial aggregates.  Results are the same.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that one task reads well, and the most buckets of a table.
ROWS_PER_BUCKET, MOST_BUCKETS = 2_000_000, 50_000
#: A bucket stands out if it holds so many times the mean (and more than ROWS_PER_BUCKET rows).
HOT_TIMES = 4
_LAYOUT = "key string, buckets int, sort array<string>, n_rows long, largest long, columns string"


def bucket_count(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets for a table of so many rows; tables that are joined take the same number."""
    return max(1, min(MOST_BUCKETS, math.ceil(n_rows / rows_per_bucket)))


def _name(path: str) -> str:
    return "bucketed_" + hashlib.md5(path.encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, sort: Sequence[str] = ()) -> None:
    """Overwrite the table at ``path``, in ``buckets`` buckets of ``key``, files sorted by ``sort``.

    Reads ``df`` twice: for the rows of each bucket, and to write.  A bucket of more than
    twice the mean is dealt to several tasks by a hash of its rows, so no task writes all
    rows of a hot key.  A null key lies in a bucket like any other; an empty table is written
    with its columns.
    """
    spark, bucket = df.sparkSession, F.pmod(F.hash(key), F.lit(buckets))
    sizes = {r[0]: r[1] for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row per bucket
    total, largest = sum(sizes.values()), max(sizes.values(), default=0)
    twice = max(1, 2 * math.ceil(total / buckets))
    split = [(b, math.ceil(n / twice)) for b, n in sizes.items() if n > twice]
    piece = F.lit(0)
    rows = df
    if split:
        pieces = F.broadcast(spark.createDataFrame(split, "__bucket int, __pieces int"))
        rows = df.withColumn("__bucket", bucket).join(pieces, "__bucket", "left")
        piece = F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id() % 1021), F.coalesce("__pieces", F.lit(1)))
    rows = rows.repartition(buckets + sum(n - 1 for _, n in split), bucket, piece).select(*df.columns)
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, *sort).saveAsTable(_name(path))
    layout = spark.createDataFrame([(key, buckets, [key, *sort], total, largest, df.schema.json())], _LAYOUT)
    layout.coalesce(1).write.mode("overwrite").json(f"{path}_layout")


def read_bucketed(spark: SparkSession, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The table at ``path``, declared with its buckets in this session's catalog unless a bucket stands out."""
    layout = spark.read.schema(_LAYOUT).json(f"{path}_layout").first()
    schema = StructType.fromJson(json.loads(layout.columns))
    plain = spark.read.schema(schema).parquet(path)
    if layout.largest > max(rows_per_bucket, HOT_TIMES * layout.n_rows / layout.buckets):
        return plain
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    spark.sql(f"CREATE TABLE {_name(path)} ({columns}) USING parquet CLUSTERED BY (`{layout.key}`) SORTED BY ({quoted(layout.sort)}) "
              f"INTO {layout.buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))


@contextmanager
def sharing_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made inside may join on more columns than the bucket key without an exchange."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)
