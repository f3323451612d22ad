"""Driver queries of the operators: ``name -> fn(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm import (decontaminate, exact_dedup, html_extract, jaccard_join, langid, minhash, mixing, pii, spelling, suffix_dedup, token_align, token_count,
                           url_filter)
from cartwheel.llm.common import shared_path, small_batches, table, written

URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]
PII_KEY = "cartwheel-example-key"
TOKENIZER, OTHER_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.parse_rules(URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so every distinct text is encoded in this run."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, str(public_tokenizers.path(TOKENIZER)), shared_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with surrogates; the key stands in for a secret of the site."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_replaced", "pii_types")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), width=3, percent=85)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_align.align(docs, *(str(public_tokenizers.path(t)) for t in (TOKENIZER, OTHER_TOKENIZER)))
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    with small_batches(spark):
        aligned = written(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "links", digest), "aligned")
    scored = token_align.score_links(aligned, token_align.link_counts(aligned))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filter, op2_suffix_dedup, op3_token_counts, op4_jaccard_join, op5_language_id, op6_exact_dedup, op7_mixing,
                                    op8_html_extraction, op9_decontamination, op10_pii, op11_spelling_variants, op12_minhash_dedup, op13_token_alignment)}
