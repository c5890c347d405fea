"""A training corpus from ``documents``: identify, deduplicate, redact, mix and tokenize.

Every stage takes documents with any further columns, and keeps them, but for the last one.  A row without a text goes in the
first stage, which leaves no empty text; the others let such rows through.  A row without an id is a document of its own up
to the mixing, which counts all of those as one.  Of rows that repeat an id near-dedup keeps one.  Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import bpe, langid, mixing, secrets, simhash
from chronoweave.llm.common import new_folder, remove_folder, table, through_parquet


#: Texts in a batch that an executor and a Python worker pass each other; both keep the memory that their largest batch took.
BATCH_ROWS = 1_000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with the session's batches set to ``BATCH_ROWS``, which holds on, since its result is read later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or that no mixture of the known languages explains."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of texts whose 5-word shingles have a similarity of 0.8 or more."""
    return simhash.keep_one_similar(docs, words=5, least=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by marks."""
    return secrets.redact_documents(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that the domains' tokens come to the target shares; clean ones once at least."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.apply_mix(docs, labelled, keep="good")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, with a digest of the text that they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", in_small_batches(identify_language)),
    ("SimHash near-dedup", in_small_batches(drop_near_duplicates)),
    ("secret scans", in_small_batches(redact_secrets)),
    ("mixing sources to target weights", in_small_batches(mix_domains)),
    ("BPE encoding and decoding", in_small_batches(encode)),
]

#: Fingerprints, models and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other; each result is written as Parquet and read again.

    A stage's folder goes once the next one has been written; the one that the result reads stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_folder(spark)
        docs = through_parquet(stage(spark, docs, sf_dir), path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
