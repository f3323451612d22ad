"""Hot keys: a user owning a third of all rows gets the same answer as a brute-force
implementation of the same rule, through the skew-split code paths."""

import datetime as dt
import hashlib

import numpy as np

from cartwheel.operators import recommend as rc
from cartwheel.operators import sampling as sp


def _draws_reference(tx_rows, ratio=1, seed=42):
    pos = {}
    for u, a in tx_rows:
        pos.setdefault(u, set()).add(a)
    items = sorted({a for _, a in tx_rows})
    prime = next(p for p in range(max(2, len(items)), 2 * len(items) + 3) if all(p % d for d in range(2, p)))
    out = set()
    for u, bought in pos.items():
        number = lambda what: int(hashlib.md5(f"{seed}:{u}:{what}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        start, step = number("start") % prime, 1 + number("step") % (prime - 1)
        order = [(start + j * step) % prime for j in range(prime)]
        left = [items[k] for k in order if k < len(items) and items[k] not in bought]
        out |= {(u, a) for a in left[:len(bought) * ratio]}
    return out


def test_negatives_hot_user_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", f"a{int(i):03d}") for i in rng.choice(300, 70, replace=False)]
    for u in range(25):
        rows += [(f"u{u:02d}", f"a{int(i):03d}") for i in rng.choice(300, 1 + u % 4, replace=False)]
    rows += [("hot", rows[0][1])] * 30            # repeats: the hot user holds a third of all rows
    tx = spark.createDataFrame(rows, "customer_id string, article_id string")
    got = {(r.customer_id, r.article_id) for r in sp.negatives(tx, ratio=1, block=16).collect()}
    assert got == _draws_reference(rows)


def test_draws_of_negatives_are_not_shuffled(spark):
    rows = [(f"u{u}", f"a{(u * 7 + n) % 40}") for u in range(12) for n in range(5)] + [("u1", "a39"), ("u2", "a38")]
    tx = spark.createDataFrame(rows, "customer_id string, article_id string")
    neg = sp.negatives(tx, ratio=3, block=4)
    assert {(r.customer_id, r.article_id) for r in neg.collect()} == _draws_reference(rows, 3)
    plan = neg._jdf.queryExecution().optimizedPlan().toString()
    draws = plan.index("explode(slice(free")
    # only kept survivors are exploded, and above them nothing but the join with the articles
    assert "LeftAnti" not in plan and plan[:draws].count("Join") == 1


def test_cache_lookup_hot_user_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    t0 = dt.datetime(2024, 1, 1)
    views = sorted(t0 + dt.timedelta(minutes=int(x)) for x in rng.integers(0, 24 * 60, 400))
    clicks = sorted(t0 + dt.timedelta(minutes=int(x), seconds=30) for x in rng.integers(0, 24 * 60, 300))
    req = spark.createDataFrame([(i, "hot", 10, t) for i, t in enumerate(clicks)] + [(10_000, "cold", 10, t0)],
                                "request_id long, user_id string, top_k int, ts timestamp_ntz")
    comp = spark.createDataFrame([("hot", 10, t) for t in views] + [("hot", 20, t0)], "user_id string, top_k int, computed_at timestamp_ntz")
    got = {r.request_id: (r.source, r.cached_at) for r in rc.cache_lookup(req, comp, ttl_seconds=1800).collect()}
    for i, t in enumerate(clicks):
        prior = [v for v in views if v <= t]
        fresh = prior and (t - prior[-1]).total_seconds() < 1800
        assert got[i] == (("cache", prior[-1]) if fresh else ("compute", None))
    assert got[10_000] == ("compute", None)
