"""Readers, writers and small resolution helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.sources import schemas

# Id column pairs accepted by the studied loaders, in preference order.
ID_PAIRS = (("user_id", "item_id"), ("customer_id", "article_id"))
ALT_ITEM_KEYS = {"item_id": "article_id"}
REQUIRED_METADATA = ("article_id", "product_type_name", "colour_group_name", "garment_group_name",
                     "product_group_name", "detail_desc")
DEFAULT_MODEL_CONFIG = {"embedding_dim": 32, "user_id_col": "customer_id", "item_id_col": "article_id", "top_k": 10}


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header CSV read as text (no inference), then each present column cast to its
    declared type; absent columns stay absent (they are optional downstream)."""
    raw = spark.read.option("header", True).csv(path)
    types = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns])


def read_raw_transactions(spark: SparkSession, path: str, lenient_dates: bool = False) -> DataFrame:
    """Declared types, ids as text; ``t_dat`` parsed to a date.

    A malformed date fails the job (ANSI, like the studied loader); ``lenient_dates``
    turns it into NULL instead, so the NULL-key rule drops the row.
    """
    df = _csv(spark, path, schemas.RAW_TRANSACTIONS)
    if lenient_dates:
        return df.withColumn("t_dat", F.try_to_timestamp(F.col("t_dat"), F.lit("yyyy-MM-dd")).cast("date"))
    return df.withColumn("t_dat", F.to_date("t_dat"))


def read_raw_articles(spark: SparkSession, path: str) -> DataFrame:
    """``article_id`` stays text (keeps leading zeros)."""
    return _csv(spark, path, schemas.RAW_ARTICLES)


def read_raw_customers(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return _csv(spark, path, schemas.RAW_CUSTOMERS)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, wherever the path's file system is; an absent one is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def resolve_first_existing(spark: SparkSession, base: str, candidates: Sequence[str]) -> str:
    """The first candidate under ``base`` that exists (file system or catalog table)."""
    for c in candidates:
        p = f"{base.rstrip('/')}/{c}"
        if path_exists(spark, p):
            return p
        if spark.catalog.tableExists(c):
            return c
    raise FileNotFoundError(f"none of {list(candidates)} under {base}")


def resolve_id_columns(*dfs: DataFrame) -> tuple[str, str]:
    """The id pair present in every given table; error if none."""
    for u, i in ID_PAIRS:
        if all(u in d.columns or i in d.columns for d in dfs) and any(u in d.columns for d in dfs) \
                and any(i in d.columns for d in dfs):
            return u, i
    raise ValueError("no shared (user, item) id columns")


def canonical_ids(df: DataFrame, user_col: str, item_col: str) -> DataFrame:
    """Rename the resolved pair to ``user_id`` / ``item_id`` as text."""
    out = df
    if user_col in out.columns:
        out = out.withColumn(user_col, F.col(user_col).cast("string")).withColumnRenamed(user_col, "user_id")
    if item_col in out.columns:
        out = out.withColumn(item_col, F.col(item_col).cast("string")).withColumnRenamed(item_col, "item_id")
    return out


def normalize_item_key(df: DataFrame) -> DataFrame:
    """``item_id`` -> ``article_id`` when only the alternate name is present."""
    for alt, canon in ALT_ITEM_KEYS.items():
        if alt in df.columns and canon not in df.columns:
            df = df.withColumnRenamed(alt, canon)
    return df


def check_metadata(df: DataFrame, required: Sequence[str] = REQUIRED_METADATA) -> DataFrame:
    """Fail early when metadata lacks a required column (schema check, no data read)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"metadata is missing columns: {missing}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None,
                sort_within: Sequence[str] | None = None) -> None:
    """Overwrite a table; optional partitioning (e.g. by month) and in-file sort.

    Rows of a partitioned table are ranged by partition and sort columns first, so every
    partition is written by one task or a few neighbours, not by all.
    """
    if partition_by:
        by = [*partition_by, *(sort_within or [])]
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    elif sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)  # text as it is
    else:
        w.format(fmt).save(path)


def known_ids(metadata: DataFrame, col: str = "article_id") -> DataFrame:
    """Distinct known ids as a table (never a driver-side list)."""
    return metadata.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()


def id_picker(df: DataFrame, preferred: str = "customer_id", n: int = 500) -> DataFrame:
    """First n distinct ids in id order; falls back to the first column."""
    col = preferred if preferred in df.columns else df.columns[0]
    return df.select(F.col(col).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct().orderBy("id").limit(n)


def save_model_config(spark: SparkSession, config: dict, path: str) -> None:
    """One-row JSON."""
    row = {**DEFAULT_MODEL_CONFIG, **config}
    spark.createDataFrame([row], schemas.MODEL_CONFIG).coalesce(1).write.mode("overwrite").json(path)


def load_model_config(spark: SparkSession, path: str) -> dict:
    """The saved settings, defaults for absent fields or an absent file."""
    if not path_exists(spark, path):
        return dict(DEFAULT_MODEL_CONFIG)
    df = spark.read.schema(schemas.MODEL_CONFIG).json(path)
    row = df.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in DEFAULT_MODEL_CONFIG.items()]).first()
    return row.asDict() if row else dict(DEFAULT_MODEL_CONFIG)
