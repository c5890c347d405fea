"""Ids beside a null id in one batch: 2 ** 53 + 1 is the first whole number that a float cannot hold."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import bpe, langid, mixing, quantized_search, secrets, simhash, spotsigs, substrings, toxicity, wrappers
from chronoweave.llm.common import through_parquet

LARGE = 2**53 + 1
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the quick brown fox jumps over the lazy dog and sees that it was not a dog at all password=abcdefghij12"
TEXTS = [WORDS, WORDS + " but a cat", "le chat est dans la maison et il dort sur un lit"]
IDS = [LARGE, None, LARGE + 2]


@pytest.fixture(scope="module")
def docs(make_docs):
    return make_docs(TEXTS, ["en", "en", "fr"], IDS).coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(LARGE, 1, 0), (None, 1, 1), (LARGE + 2, 0, 1)], "doc_id long, quality int, toxic int")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda i: (i is not None, i or 0))


WANT = sorted(IDS, key=lambda i: (i is not None, i or 0))


def test_documents(docs, labels):
    model = langid.fit(docs)
    domains = labels.select("doc_id", mixing.label_domain().alias("domain"))
    whole = bpe.encode_documents(docs, PATH)
    got = {
        "op2": secrets.find_secrets(docs), "redact": secrets.redact_documents(docs), "op3": mixing.mix(docs, domains), "op4": langid.predict(docs, model),
        "identified": langid.keep_identified(docs), "op6": bpe.digest_documents(docs, PATH), "encode": whole, "decode": bpe.decode_ids(whole, PATH),
        "op7": spotsigs.fingerprint_documents(docs), "op8": substrings.remove_repeats(docs), "op9": toxicity.predict(docs, toxicity.fit(docs, labels)),
        "op10": simhash.simhash_components(docs), "one": simhash.keep_one(docs),
    }
    for name, df in got.items():
        assert ids(df) == WANT, name
    similar = simhash.similar_components(docs)
    assert ids(similar) == WANT[1:] and ids(similar, "component_id") == WANT[1:]
    assert ids(got["op10"], "component_id") == WANT


def test_pages(spark):
    pages = spark.createDataFrame([(LARGE, "http://a.example/1", "<p>one</p>"), (None, "http://a.example/2", "<p>two</p>")], "page_id long, url string, html string").coalesce(1)
    assert ids(wrappers.extract_pages(pages), "page_id") == [None, LARGE]


def test_vectors(spark):
    rows = [(LARGE, [1.0, 0.0]), (None, [1.0, 1.0]), (LARGE + 2, [2.0, 1.0])]
    found = quantized_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), F.col("vec_id") == LARGE).collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(LARGE, LARGE + 2)]


def test_stages(docs, spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, sf)
        assert set(ids(now)) <= set(WANT) and (name == "mixing sources to target weights" or ids(now) == WANT), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns and through_parquet(now).columns == docs.columns
