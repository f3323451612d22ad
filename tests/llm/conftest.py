import pytest
from odd_rows import ODD, SF
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns named like the operators' own."""
    names = ["kept", "keep_id", "n_tokens", "n_bytes", "lang_pred", "score", "host", "rule", "size", "target", "taken", "component_id", "n_replaced", "cell", "id", "key"]
    return odd.withColumns({c: F.lit("mine") for c in names})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
