"""From raw documents to a training mix, as five stages over the table ``documents``.

Every stage takes all that its predecessor kept, drops the documents it decides against
and returns the columns it was given; the last one adds what the mix takes of each
document.  Stages are handed over as Parquet in the shared folder, so a lost executor
costs at most the tasks it ran, and every join sees real table sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm import decontaminate, exact_dedup, jaccard_join, langid, mixing
from cartwheel.llm.common import table, written

#: Near duplicates: shingles of so many words, Jaccard similarity of so many per cent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; those without a letter, or whose letters the model mostly does not know, go."""
    return langid.keep_known(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, directly or through others, the one with the smallest doc_id.

    Rows without a doc_id belong to no group and stay.
    """
    groups = jaccard_join.link_components(docs, width=NEAR_WORDS, percent=NEAR_PERCENT)
    spare = written(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(spare, "doc_id", "left_anti").select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_leaky(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes words of, with ``size, source_size, target, taken``."""
    return mixing.mix(docs, keep=True).filter("taken > 0")


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("mixed", mixed)]

#: Language identification has no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
