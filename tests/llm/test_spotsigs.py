import hashlib
import random
import re

import numpy as np

from chronoweave.llm import spotsigs as S
from chronoweave.llm.common import table


def test_equal_texts_equal_sets_and_likeness():
    a, b = S.signatures("The house of the old man is on a hill."), S.signatures("the HOUSE of the old man is on a hill")
    assert (a == b).all() and S.likeness(a, b) == 1.0
    assert S.likeness(S.signatures(""), S.signatures(None)) == 1.0 and S.likeness(a, S.signatures("")) == 0.0
    assert len(S.signatures("xyz")) == 1


def test_pruned_likeness_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint32) for _ in range(2))
        union = len(set(a) | set(b))
        exact = len(set(a) & set(b)) / union if union else 1.0
        assert S.likeness(a, b) == exact
        assert S.likeness(a, b, 0.5) in ((exact,) if exact >= 0.5 else (exact, 0.0))
        if exact >= 0.5:
            assert abs(S.partition_of(len(a), 0.5) - S.partition_of(len(b), 0.5)) <= 1
        assert (S.from_text(S.as_text(a)) == a).all()


def check(rows, docs):
    docs = sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    got = {(r["doc_id"], r["edited_sha256"]): r for r in rows}
    assert len(rows) == len(docs)
    for i, d in enumerate(docs):
        t, u = d["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[d["doc_id"], hashlib.sha256(e.encode()).hexdigest()]
        assert r["n_chars"] == len(t) and r["fingerprint"] == S.as_text(S.signatures(t)) and r["edited_fingerprint"] == S.as_text(S.signatures(e))
        assert r["near_edited"] == S.likeness(S.signatures(t), S.signatures(e)) and r["near_next"] == S.likeness(S.signatures(t), S.signatures(u))


def test_rows_against_brute_force(spark, sf, odd_docs):
    docs = table(spark, sf, "documents").repartition(7)
    check(S.fingerprint_documents(docs).collect(), docs.collect())
    check(S.fingerprint_documents(odd_docs).collect(), odd_docs.collect())
    check(S.fingerprint_documents(odd_docs.limit(1)).collect(), odd_docs.limit(1).collect())
    assert S.fingerprint_documents(odd_docs.limit(0)).count() == 0


def brute_signatures(text):
    """Anchor and the next two words that are none; without a whole chain every word is an anchor of its own."""
    words = re.findall(r"\w+", (text or "").lower())
    found = set()
    for i, w in enumerate(words):
        if w in S.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in S.ANCHORS][:2]
            if chain:
                found.add((w, *chain))
    if not any(len(x) == 3 for x in found):
        found = {tuple(["", *words[i : i + 2]]) for i in range(len(words))}
    return found


def test_classes_against_brute_force(spark, make_docs):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)] + sorted(S.ANCHORS)[:40] * 6
    texts = [None, "", "one", "the one"]
    for n in (8, 20, 60, 200) * 3:
        base = rnd.choices(words, k=n)
        texts.append(" ".join(base))
        for share in (0.0, 0.01, 0.02, 0.05, 0.1):
            texts.append(" ".join(rnd.choice(words) if rnd.random() < share else w for w in base))
    sets = [frozenset(brute_signatures(t)) for t in texts]
    like = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if like(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    distinct = set(sets)
    want = {i: (find(i), sum(x != sets[i] and like(x, sets[i]) >= 0.8 for x in distinct)) for i in range(len(texts))}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in S.near_duplicate_classes(make_docs(texts)).collect()}
    assert got == want and any(n for _, n in want.values())


def test_classes_of_odd_rows(odd_docs):
    got = {r["doc_id"]: r["class_id"] for r in S.near_duplicate_classes(odd_docs).collect()}
    assert None not in got and got[0] == got[1] == got[2] == got[6] == 0 and got[9] == 9
    assert S.near_duplicate_classes(odd_docs.limit(0)).count() == 0
