"""The queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, langid, mixing, quantized_search, secrets, simhash, spotsigs, substrings, toxicity, wrappers
from chronoweave.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.mix(table(spark, sf_dir, "documents"), labelled)


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(langid.training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "languages")


def op5_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 7: near duplicates over length partitions with pruned Jaccard."""
    return spotsigs.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_page_wrappers, op2_secrets, op3_soft_mixture, op4_language_mixture, op5_anisotropic_search, op6_bpe_round_trip, op7_spotsigs, spotsigs_classes, op8_repeated_substrings, op9_toxicity, op10_simhash_components)}

#: DuckDB text for what SQL can express.
ORACLE_SQL: dict[str, str] = {}
