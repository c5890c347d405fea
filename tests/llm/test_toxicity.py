import numpy as np
from pyspark.sql import functions as F

from chronoweave.llm import boosting
from chronoweave.llm import toxicity as T
from chronoweave.llm.common import table


def test_isotonic_is_monotone_and_best():
    rng = np.random.default_rng(0)
    s = np.round(rng.normal(size=200), 1)
    y = (rng.random(200) < 1 / (1 + np.exp(-s))).astype(float)
    xs, ys = boosting.isotonic(s, y)
    assert (np.diff(ys) >= -1e-12).all() and (np.diff(xs) > 0).all()
    assert abs(np.interp(s, xs, ys).mean() - y.mean()) < 1e-9


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((800, 4))
    y = ((x[:, 1] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    m = boosting.fit_boosted(x[:600], y[:600])
    assert ((m.margin(x[600:]) > 0) == (y[600:] > 0.5)).mean() > 0.95
    assert boosting.fit_boosted(x, np.zeros(800)).margin(x[:2]).max() < 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = T.fit(docs, labels)
    rows = T.predict(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) >= 0.9


def test_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(odd_docs, none)
    assert T.predict(odd_docs, model).count() == odd_docs.count()
    assert T.predict(odd_docs.limit(0), model).count() == 0
    some = spark.createDataFrame([(i, 1, i % 2) for i in range(10)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert T.predict(odd_docs, T.fit(odd_docs, some)).count() == odd_docs.count()
    assert T.Lexicon({}, {}).features("you IDIOT id1ot you")[T.FEATURES.index("near_second")] == 2
