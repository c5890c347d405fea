import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import langid, mixing, secrets
from chronoweave.llm.common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def shingles(text):
    """Five words each; a shorter text is one shingle of all its words."""
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_each_stage_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").cache()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, docs, sf)
    assert kept.columns == docs.columns
    model = langid.fit(langid.training_rows(docs))
    want = {r["doc_id"] for r in docs.collect() if model.identified(r["text"])}
    assert {r["doc_id"] for r in kept.collect()} == want

    one = stages["SimHash near-dedup"](spark, kept, sf)
    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (not x | y or len(x & y) >= 0.8 * len(x | y)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in one.collect()} == {i for i in ids if find(i) == i}

    clean = {r["doc_id"]: r for r in stages["secret scans"](spark, one, sf).collect()}
    for r in one.collect():
        text = secrets.redact(r["text"], secrets.scan(r["text"]))
        assert clean[r["doc_id"]]["text"] == text and clean[r["doc_id"]]["n_chars"] == (len(text) if text != r["text"] else r["n_chars"])

    mixed = stages["mixing sources to target weights"](spark, one, sf)
    assert mixed.columns == docs.columns
    labelled = table(spark, sf, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    copies = {}
    for r in mixing.mix(one, labelled).collect():
        good = r["p_good"] >= max(r["p_low"], r["p_toxic"])
        u = zlib.crc32(f"mix{r['doc_id']}".encode()) / 2**32
        copies[r["doc_id"]] = max(int(r["rate"] + u), good)
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    got = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert got == Counter({(i, texts[i]): n for i, n in copies.items() if n})
    for r in stages["BPE encoding and decoding"](spark, one, sf).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        assert r["ids"] == LIB.encode(text, add_special_tokens=False).ids and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, sf):
    """Clashing names of further columns, nulls, repeats and empty tables pass all stages."""
    wild = odd_docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("copies", "_id", "key", "fp", "component", "rep", "h", "mix_id", "node", "digest", "n"))])
    now, nothing = wild, wild.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        assert stage(spark, wild, sf).columns == wild.columns or last
        now, nothing = stage(spark, now, sf), stage(spark, nothing, sf)
        assert nothing.count() == 0 and (last or now.columns == wild.columns)
    assert now.count() > 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_pass_small_batches(spark, sf):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.range(3_000).coalesce(1).selectExpr("id as doc_id", "'some words' as text")
        dict(corpus_pipeline.STAGES)["secret scans"](spark, docs, sf)
        sizes = docs.mapInPandas(lambda batches: (b.head(1).assign(n=len(b))[["n"]] for b in batches), "n long").collect()
        assert [r["n"] for r in sizes] == [corpus_pipeline.BATCH_ROWS] * 3
    finally:
        spark.conf.set(name, before)
