"""Driver contract, and every oracle on the smallest driver tables."""

import math
import os
import re
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_types import norm_duck, norm_spark  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"kmeans_recall", "sgd_factors", "sgd_evaluate", "softmax_factors", "softmax_history", "als_factors", "als_evaluate", "topk_ivf_kmeans"}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "purchase_count" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    from cartwheel.plans.registry import ROWS_ONLY
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    corpus = {n for n in q if re.match(r"op\d+_|pipeline$", n)}   # tested on their own where SQL cannot express them
    assert set(q) - set(o) - corpus == ROWS_ONLY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle_matches(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    types = {c: norm_duck(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert {c: norm_spark(t) for c, t in sdf.dtypes} == types            # same schema, not only names
    cur = duck.execute(entry.oracle_sql()[name])
    dcols = [x[0] for x in cur.description]
    assert sorted(dcols) == cols
    want = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(SLOW))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
