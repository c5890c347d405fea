import random

import numpy as np
import xxhash

from chronoweave.llm import simhash as H
from chronoweave.llm.components import components


def brute_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for text in (None, "", "A", "a b", "À b\x0bc d e", "the Quick brown fox the quick brown", "x " * 3000):
        assert H.fingerprint(text) == brute_fp(text)


def test_links_and_components(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(12)})
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp long, rep long")
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
    for blocks in (3, 5, 7):
        got = {(min(r), max(r)) for r in H.near_links(df, 2, blocks=blocks).collect()}
        assert got == want
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(list(want), "a long, b long")).collect()}
    brute = brute_components(want, range(len(fps)))
    assert found == {n: c for n, c in brute.items() if n in found} and all(brute[n] == n for n in brute if n not in found)


def test_long_chain(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n).tolist()
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(5000, 5001), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    assert all(found[i] == 0 for i in range(n)) and found[5001] == 5000


def test_rows(odd_docs, make_docs):
    got = {r["doc_id"]: r for r in H.simhash_components(odd_docs).collect()}
    assert len(got) == odd_docs.count()
    assert got[0]["fp"] == 0 and {got[i]["component_id"] for i in (0, 1, 2, 6)} == {0} and got[10]["component_id"] == 9
    kept = H.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 9 in ids and 10 not in ids and ids.count(0) == 1 and None in ids
    assert H.simhash_components(odd_docs.limit(0)).count() == 0
    repeated = make_docs(["one two three four"] * 3, ids=[4, 4, 2])
    assert [r["doc_id"] for r in H.keep_one(repeated).collect()] == [2]
