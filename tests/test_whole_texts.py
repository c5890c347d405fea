import re

from chronoweave.functions import vocabulary as V
from chronoweave.plans.registry import QUERIES
from chronoweave.sources import testdata as T


def test_whole_texts_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"].replace("\n", " ") for r in T.table(spark, sf, "documents").collect()}
    conn = {r["k"]: r for r in QUERIES["fn_connectives"](spark, sf).collect()}
    ctx = {r["k"]: r for r in QUERIES["fn_context_words"](spark, sf).collect()}
    assert set(conn) == set(ctx) == set(texts)
    for k, text in texts.items():
        low = [w.lower() for w in text.split(" ")]
        assert conn[k]["conn"] == ",".join(sorted({w for w in low[1:-1] if w in V.CONNECTIVES}))
        words = [w for w in re.findall("[a-z]+", text.lower()) if len(w) > 2 and w not in V.MONTHS]
        assert conn[k]["content"] == ",".join(words[:4])
        at = k % len(low)
        assert ctx[k]["prep"] == ",".join(dict.fromkeys(w for w in low[max(at - 3, 0) : at] if w in V.PREPOSITIONS))
        near = [f"{n}={low[at + d]}" for n, d in (("p2", -2), ("p1", -1), ("n1", 1)) if 0 <= at + d < len(low)]
        assert ctx[k]["ctx"] == ",".join(near)
