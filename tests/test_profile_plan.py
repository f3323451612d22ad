"""The type report counts distinct values without copying rows per column."""

from cartwheel.operators import profile


def test_dtype_report_has_no_expand(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 3), (None, None, 4), ("a", 2.0, None)], "k string, x double, n int")
    report = profile.dtype_report(df)
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
    assert {r["column_name"]: r["unique_values"] for r in report.collect()} == {"k": 2, "x": 2, "n": 2}
    assert {r["unique_values"] for r in profile.dtype_report(df.limit(0)).collect()} == {0}
