import random

import pytest

from chronoweave.llm import simhash
from chronoweave.llm.common import table

corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(texts):
    """Ids that are the smallest of their component, by all pairs' Jaccard similarity."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


def test_stage_equals_brute_force_jaccard(spark, sf, make_docs):
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (30, 60, 120, 400) * 4:
        base = rnd.choices(words, k=n)
        texts.append(" ".join(base))
        for share in (0.004, 0.008, 0.015, 0.02):
            texts.append(" ".join(rnd.choice(words) if rnd.random() < share else w for w in base))
    docs = make_docs(texts)
    want = brute(dict(enumerate(texts)))
    assert len(want) < len(texts) / 2
    assert {r["doc_id"] for r in stage(spark, docs, sf).collect()} == want
    # the old rule of fingerprints within two bits leaves near copies
    assert {r["doc_id"] for r in simhash.keep_one(docs, words=3, radius=2).collect()} != want


def test_stage_on_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()}
    assert got == brute({r["doc_id"]: r["text"] for r in docs.collect()})


def test_odd_rows(spark, odd_docs):
    got = simhash.keep_one_similar(odd_docs)
    assert got.columns == odd_docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert None in ids and len(ids) == len(set(ids)) and 10 not in ids


@pytest.mark.parametrize("block", [2_000, 7])
def test_group_of_near_copies(spark, make_docs, monkeypatch, block):
    """Edited copies that mostly are within 0.8 of their origin and not of each other, beside a passage that others share."""
    monkeypatch.setattr(simhash, "BAND_BLOCK", block)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base, passage = rnd.choices(words, k=150), rnd.choices(words, k=60)
    texts = [" ".join(base)]
    for _ in range(120):
        copy = list(base)
        for i in rnd.sample(range(150), rnd.randint(2, 6)):
            copy[i] = rnd.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(passage + rnd.choices(words, k=rnd.randint(5, 40))) for _ in range(60)]
    rnd.shuffle(texts)
    got = {r["doc_id"] for r in simhash.keep_one_similar(make_docs(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_which_row_of_an_id_stays(make_docs):
    docs = make_docs(["b one two three four five", "a one two three four six", None, "other words here and there now"], ids=[4, 4, 5, 5])
    assert {(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()} == {(4, "a one two three four six"), (5, None)}


def test_pivots_link_fingerprints_of_sets(spark, make_docs, monkeypatch):
    """Without any band, texts within reach of the pivots are linked, and only those whose shingles are near."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(8):
        base = rnd.choices(words, k=900)
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for i in rnd.sample(range(900), rnd.randint(1, 3)):
                copy[i] = rnd.choice(words)
            texts.append(" ".join(copy))
    docs = make_docs(texts)
    sets = [simhash.shingle_set(t) for t in texts]
    fps = [simhash.fingerprint(t, words=5) for t in texts]
    assert [int(simhash.wide_fingerprint(s)[0]) for s in sets] == fps  # no shingle repeats
    within = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= simhash.REACH}
    first = {}
    for i, x in enumerate(fps):
        first.setdefault(x, i)
    real = simhash._sets
    pairs = {tuple(r) for r in simhash.pivot_pairs(real(docs, 5), len(texts)).collect()}
    assert pairs == {(i, j) for i, j in within if (first[fps[i]], first[fps[j]]) in ((i, j), (i, i))}
    linked = len({j for _, j in within})
    assert linked > 20
    monkeypatch.setattr(simhash, "_sets", lambda d, w: real(d, w).selectExpr("doc_id", "digest", "n", "cast(array() as array<long>) as keys", "bits"))
    kept = {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()}
    root = brute(dict(enumerate(texts)))
    assert root <= kept and len(kept) <= len(texts) - linked


def test_near_sets_pass_their_bits():
    rnd = random.Random(5)
    for common, more in ((4, (0, 1)), (8, (1, 1)), (12, (0, 3)), (40, (5, 5)), (200, (25, 25)), (400, (0, 100))):
        for _ in range(40):
            a, b = ([rnd.getrandbits(64) for _ in range(k)] for k in more)
            both = [rnd.getrandbits(64) for _ in range(common)]
            x, y = (simhash.np.array(both + z, simhash.np.uint64) for z in (a, b))
            apart = sum((int(i) ^ int(j)).bit_count() for i, j in zip(simhash.wide_fingerprint(x), simhash.wide_fingerprint(y)))
            assert apart <= simhash.most_apart(min(len(x), len(y)), 0.8)
    unrelated = [simhash.wide_fingerprint(simhash.np.array([rnd.getrandbits(64) for _ in range(100)], simhash.np.uint64)) for _ in range(2)]
    assert sum((int(i) ^ int(j)).bit_count() for i, j in zip(*unrelated)) > simhash.most_apart(100, 0.8) + 150


def test_steps_write_few_files(spark, make_docs, monkeypatch):
    """A small table's checkpoints have few partitions, whatever the session's number."""
    real, counts = simhash.cut, []

    def counted(df):
        counts.append(df.rdd.getNumPartitions())
        return real(df)

    monkeypatch.setattr(simhash, "cut", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        simhash.similar_components(make_docs(["a b c d e f g h", "a b c d e f g h i", "x y z"] * 3)).collect()
    finally:
        for name, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"), before):
            spark.conf.set(name, value)
    assert len(counts) > 8 and all(x == 1 for x in counts[1:])
