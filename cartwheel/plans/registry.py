"""Named driver queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the canonical views) in full and
composes library operators.  Double columns are rounded to 6 places on output
so results are comparable with the SQL oracle regardless of summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.numeric import round_half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROWS_ONLY: set[str] = set()


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_up(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, rows_only: bool = False):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if rows_only:
            ROWS_ONLY.add(name)
        return fn
    return deco


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # importing the modules registers their queries
    from cartwheel.plans import q_clean, q_features, q_io, q_misc, q_profile, q_retrieval, q_sampling, q_train  # noqa: F401
    return dict(QUERIES)
