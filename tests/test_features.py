import datetime as dt
import math

from pyspark.sql import functions as F

from cartwheel.operators import context, interactions, item, user

TX = "customer_id string, article_id string, t_dat date, price double"


def d(s):
    return dt.date.fromisoformat(s)


def test_user_features_cold_start_and_frequency(spark):
    tx = spark.createDataFrame([("u1", "a1", d("2020-09-01"), 10.0), ("u2", "a1", d("2020-06-02"), 5.0),
                                ("u3", "a2", d("2020-06-03"), 1.0), ("u3", "a3", d("2020-09-01"), 3.0)], TX)
    cust = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("cold",)], "customer_id string")
    out = {r.customer_id: r for r in user.user_features(cust, tx).collect()}
    c = out["cold"]
    assert (c.purchase_count, c.days_since_last_purchase, c.active_status, c.purchase_frequency, c.total_spend) == (0, 9999, 0, 0.0, 0.0)
    assert c.avg_spend_per_txn is None and c.unique_articles is None and c.recent_purchase_date is None
    assert out["u1"].purchase_frequency == 1.0                 # single purchase: days floored at 1
    assert out["u2"].days_since_last_purchase == 91 and out["u2"].active_status == 0
    assert out["u3"].days_since_last_purchase == 0 and out["u3"].active_status == 1
    assert out["u3"].purchase_frequency == 2 / 90


def test_active_bound_90_days(spark):
    tx = spark.createDataFrame([("u1", "a1", d("2020-06-03"), 1.0), ("u2", "a1", d("2020-09-01"), 1.0)], TX)
    r = {x.customer_id: x for x in user.purchase_features(tx).collect()}
    assert r["u1"].days_since_last_purchase == 90 and r["u1"].active_status == 1


def test_item_features_unsold_and_window_bound(spark):
    tx = spark.createDataFrame([("u1", "a1", d("2020-09-01"), 2.0), ("u2", "a1", d("2020-08-02"), 4.0),
                                ("u1", "a2", d("2020-08-01"), 1.0)], TX)
    arts = spark.createDataFrame([("a1",), ("a2",), ("unsold",)], "article_id string")
    out = {r.article_id: r for r in item.item_features(arts, tx).collect()}
    assert out["a1"].purchases_last_30d == 2                    # exactly 30 days before max: counted
    assert out["a2"].purchases_last_30d == 0
    u = out["unsold"]
    assert (u.total_purchases, u.unique_buyers, u.popularity_score, u.days_since_last_sale) == (0, 0, 0.0, 0)
    assert u.avg_price is None and u.first_sold_date is None
    assert out["a1"].popularity_score == 1.0 and out["a2"].popularity_score == 0.5


def test_decay_and_calendar(spark):
    tx = spark.createDataFrame([("u", "a", d("2021-01-03"), 1.0), ("u", "a", d("2021-04-03"), 1.0)], TX)
    r = sorted(interactions.interaction_features(tx).collect(), key=lambda x: x.t_dat)
    assert r[0].week_of_year == 53 and r[0].day_of_week == 6 and r[0].year == 2021 and r[0].month == 1
    assert r[1].recency_weight == 1.0 and math.isclose(r[0].recency_weight, math.exp(-0.9))
    assert r[0].purchase_count_pair == 2 and r[0].is_repeat_purchase == 1
    p = interactions.positive_pairs(tx).collect()[0]
    assert p.pair_purchase_count == 2 and p.recency_weight == 1.0
    p90 = interactions.positive_pairs(tx, reference_date="2021-07-02").collect()[0]
    assert math.isclose(p90.recency_weight, math.exp(-1))


def test_recency_score_all_on_reference_day(spark):
    tx = spark.createDataFrame([("u", "a", d("2020-09-23"), 1.0)], TX)
    assert user.recency_score(tx, "2020-09-23").collect()[0].recency_score == 1.0


def test_context_features(spark):
    tx = spark.createDataFrame([("u", "a1", d("2021-01-02"), 1.0), ("u", "a2", d("2021-02-10"), 1.0),
                                ("u", "a2", d("2021-02-11"), 1.0)], TX)
    arts = spark.createDataFrame([("a1", "Top"), ("a2", "Dress")], "article_id string, product_type_name string")
    pref = context.preferred_attribute(tx, arts, "product_type_name").collect()[0]
    assert pref.preferred_product_type_name == "Dress"
    f = {r.t_dat: r for r in context.season_weekend_flags(tx).collect()}
    assert f[d("2021-01-02")].weekend_purchase == 1 and f[d("2021-01-02")].purchase_season == "winter"
    t = {(r.article_id, r.month): r for r in context.popularity_trend(tx).collect()}
    assert t[("a2", d("2021-02-01"))].purchases == 2 and t[("a2", d("2021-02-01"))].trend is None
