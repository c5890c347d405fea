import hashlib
import random

import numpy as np

from chronoweave.llm import substrings as B
from chronoweave.llm import suffixes as S


def brute(docs, length):
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows_of(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 7))) for _ in range(200)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 6))]
        texts.append(" ".join(parts))
    texts += ["ab" * 150, "aaaaaaaa" * 40, "a" * 99, "a" * 100, "a" * 101, texts[3], texts[4], None, ""]
    return list(enumerate(texts))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "PART", 700)
    for seed in range(3):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        for length in (100, 40):
            assert rows_of(B.remove_repeats(df, length)) == brute(docs, length)


def test_odd_rows(odd_docs):
    assert B.remove_repeats(odd_docs).count() == odd_docs.count()
    assert B.remove_repeats(odd_docs.limit(0)).count() == 0
    twice = odd_docs.where("doc_id = 8").unionByName(odd_docs.where("doc_id = 8"))
    assert len({tuple(r) for r in B.remove_repeats(twice).collect()}) == 1


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(150):
        t = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint8)
        b = t.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        order = S.suffix_array(t)
        assert order.tolist() == want
        lcp = S.adjacent_prefixes(S.words(t), order)
        for j in range(1, len(b)):
            x, y = b[want[j - 1] :], b[want[j] :]
            k = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert lcp[j] == k


def test_small_parts_against_brute_force(spark, monkeypatch):
    """Groups in many parts, claims in many segments, pieces in many copies."""
    monkeypatch.setattr(B, "ARRAY_BYTES", 300)
    monkeypatch.setattr(B, "SEGMENT", 64)
    docs = corpus(7, 30)
    docs += [(100 + i, docs[5][1] + " " + docs[6][1]) for i in range(12)] + [(200 + i, str(i) + docs[8][1]) for i in range(6)]
    assert rows_of(B.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 100)) == brute(docs, 100)


def test_hashes_only_propose(spark, monkeypatch):
    """Where all hashes of whole occurrences collide the suffix arrays still decide by the bytes."""
    monkeypatch.setattr(B.Hasher, "of", lambda self, sums, start, end: np.zeros(len(start), np.uint64))
    docs = corpus(3, 20)
    got = rows_of(B.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 100))
    want = brute(docs, 100)
    assert all(got[i][1] <= want[i][1] for i in want)  # a claim on a wrong place is turned down, no byte goes that is no repeat
