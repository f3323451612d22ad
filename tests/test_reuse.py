"""Reuse of lists when a miss fills the cache: equal to walking through the requests."""

import datetime as dt
import random

from cartwheel.operators.reuse import cache_sessions

START = dt.datetime(2024, 3, 10, 1, 30)
SCHEMA = "request_id long, user_id string, top_k int, ts timestamp_ntz"


def walked(rows, ttl):
    last, out = {}, []
    for rid, user, k, ts in sorted(rows, key=lambda r: (r[3] is not None, r[3] or START, r[0])):
        if user is None or k is None or ts is None:
            out.append((rid, None, "compute"))
        elif (user, k) in last and ts < last[user, k] + dt.timedelta(seconds=ttl):
            out.append((rid, last[user, k], "cache"))
        else:
            last[user, k] = ts
            out.append((rid, ts, "compute"))
    return sorted(out)


def sessions(spark, rows, ttl):
    got = cache_sessions(spark.createDataFrame(rows, SCHEMA), ttl).collect()
    return sorted((r["request_id"], r["computed_at"], r["source"]) for r in got)


def test_sessions_equal_a_walk(spark):
    rng = random.Random(8)
    rows = []
    for n in range(600):
        ts = START + dt.timedelta(seconds=rng.choice([rng.randrange(40_000), 3600 * rng.randrange(12), rng.randrange(3_000_000)]), microseconds=rng.choice([0, 0, 500_000]))
        rows.append((n, rng.choice(["a", "b", "c", None]), rng.choice([10, 20, None]), ts if n % 50 else None))
    rows += [(1000 + n, "tie", 10, START) for n in range(3)] + [(1010, "tie", 10, START + dt.timedelta(hours=1)), (1011, "one", 10, START)]
    for ttl in (3600, 60):
        assert sessions(spark, rows, ttl) == walked(rows, ttl)
    assert sessions(spark, [], 3600) == []


def test_sessions_of_one_user_with_very_many_requests(spark):
    rng = random.Random(9)
    rows = [(n, "hot", 10, START + dt.timedelta(seconds=rng.randrange(2_000_000))) for n in range(100_000)]
    assert sessions(spark, rows, 3600) == walked(rows, 3600)
