import datetime as dt

from pyspark.sql import functions as F

from cartwheel.operators import clean

TX = "customer_id string, article_id string, t_dat date, price double, sales_channel_id int"
D = dt.date(2020, 9, 1)


def test_duplicates_exact_and_key(spark):
    rows = [("c1", "a1", D, 10.0, 1), ("c1", "a1", D, 10.0, 1), ("c1", "a1", D, 12.0, 1), ("c2", "a1", D, 5.0, 2)]
    df = spark.createDataFrame(rows, TX)
    assert clean.drop_full_duplicates(df).count() == 3
    out = clean.drop_key_duplicates(df, clean.TX_KEYS).orderBy("customer_id").collect()
    assert [(r.customer_id, r.price) for r in out] == [("c1", 10.0), ("c2", 5.0)]


def test_key_dedupe_ignores_absent_keys(spark):
    df = spark.createDataFrame([("c1", 1.0), ("c1", 1.0), ("c1", 2.0)], "customer_id string, price double")
    assert clean.drop_key_duplicates(df, clean.TX_KEYS).count() == 1


def test_clean_transactions_nulls_median_mode(spark):
    rows = [("c1", "a1", D, 10.0, 1), ("c2", "a2", D, None, 2), ("c3", "a3", D, 30.0, None),
            (None, "a4", D, 1.0, 1), ("c5", "a5", D, 20.0, 2), ("c6", "a6", D, 40.0, 1), ("c7", "a7", D, 50.0, None)]
    out = {r.customer_id: r for r in clean.clean_transactions(spark.createDataFrame(rows, TX)).collect()}
    assert set(out) == {"c1", "c2", "c3", "c5", "c6", "c7"}          # NULL key dropped
    assert out["c2"].price == 30.0                                   # median of 10,30,20,40,50
    assert out["c3"].sales_channel_id == 1                           # tie 1,1 vs 2,2 -> smallest
    assert isinstance(out["c1"].sales_channel_id, int)


def test_ids_are_stripped_after_dedupe(spark):
    rows = [(" c1\t", "a1", D, 1.0, 1), ("c1", "a1", D, 1.0, 1)]
    out = clean.clean_transactions(spark.createDataFrame(rows, TX)).collect()
    assert [r.customer_id for r in out] == ["c1", "c1"]


def test_customers_age_fill_and_clip(spark):
    schema = "customer_id string, FN double, Active double, club_member_status string, fashion_news_frequency string, age double"
    rows = [("a", None, 1.0, None, None, None), ("b", 1.0, None, "ACTIVE", "NONE", 3.0),
            ("c", 0.0, 1.0, "ACTIVE", "Regularly", 130.0), ("d", 1.0, 1.0, "ACTIVE", "NONE", 40.0)]
    out = {r.customer_id: r for r in clean.clean_customers(spark.createDataFrame(rows, schema)).collect()}
    assert out["a"].age == 40 and out["b"].age == 15 and out["c"].age == 100   # median(3,130,40) = 40
    assert out["a"].FN == 0 and out["b"].Active == 0
    assert out["a"].club_member_status == "Unknown" and out["a"].fashion_news_frequency == "None"


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (3.0,), (130.0,)], "x double")
    assert [r.y for r in df.select(clean.clip(F.col("x"), 15, 100).alias("y")).collect()] == [None, 15.0, 100.0]


def test_articles_text_rules(spark):
    schema = "article_id string, product_type_name string, graphical_appearance_name string, section_name string, detail_desc string, product_type_no double"
    rows = [(" 0101 ", " T-shirt\t", "women's", "3d print", None, 5.0), ("0102", None, "x", "y", "Nice  Shirt ", None)]
    out = {r.article_id: r for r in clean.clean_articles(spark.createDataFrame(rows, schema)).collect()}
    a = out["0101"]
    assert (a.product_type_name, a.graphical_appearance_name, a.section_name, a.detail_desc) == \
        ("T-Shirt", "Women'S", "3D Print", "no description")
    b = out["0102"]
    assert b.product_type_name == "Unknown" and b.detail_desc == "nice  shirt" and b.product_type_no == 5


def test_clean_is_idempotent(spark):
    rows = [("c1", "a1", D, 10.0, 1), ("c1", "a1", D, 12.0, 2), ("c2", "a2", D, None, None)]
    once = clean.clean_transactions(spark.createDataFrame(rows, TX))
    twice = clean.clean_transactions(once)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_exact_quantiles_equal_spark(spark):
    from cartwheel.operators.quantiles import exact_quantiles
    rows = [(float((k * 7919) % 1000) / 3, float(k % 4), None if k % 5 else float(k)) for k in range(501)] + [(None, float("nan"), None), (-0.0, 1e300, -5.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    fractions = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], fractions)
    for c in "abc":
        x = F.when(~F.isnan(c), F.col(c))
        assert got[c] == [df.select(F.percentile(x, F.lit(f))).first()[0] for f in fractions]
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "p double")
    assert exact_quantiles(nan, ["p"], [0.5]) == {"p": [1.5]}


def test_what_leads_to_the_transactions_runs_once(spark):
    rows = [("c1", "a", dt.date(2020, 1, 1), 1.0, 1), ("c1", "a", dt.date(2020, 1, 1), 2.0, 1), ("c2", "b", dt.date(2020, 1, 2), None, None)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def price(p):
        read.add(1)
        return p

    raw = spark.createDataFrame(rows, "customer_id string, article_id string, t_dat date, p double, sales_channel_id int")
    raw = raw.select("customer_id", "article_id", "t_dat", price.asNondeterministic()("p").alias("price"), "sales_channel_id")
    out = {r.customer_id: (r.price, r.sales_channel_id) for r in clean.clean_transactions(raw).collect()}
    assert out == {"c1": (1.0, 1), "c2": (1.0, 1)} and read.value == 3


def test_tables_are_deduplicated_once(spark):
    customers = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 40.0)], "customer_id string, age double")
    articles = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", None)], "article_id string, name string")
    for cleaned in (clean.clean_customers(customers), clean.clean_articles(articles)):
        assert cleaned.count() == 2 and "Window" not in cleaned._jdf.queryExecution().executedPlan().toString()
