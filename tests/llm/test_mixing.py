import numpy as np
from pyspark.sql import functions as F

from chronoweave.llm import mixing as M
from chronoweave.llm.common import table


def totals(rows):
    n = sum(r["n_tokens"] for r in rows)
    return {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) / n for d in M.TARGETS}


def brute(rows, rounds=4000):
    """Plain projected gradient with short steps."""
    p = np.array([[r[f"p_{d}"] for d in M.TARGETS] for r in rows])
    n = np.array([r["n_tokens"] for r in rows], float)
    n /= n.sum()
    goal, w, start = np.array(list(M.TARGETS.values())), np.ones(len(rows)), n @ p
    for _ in range(rounds):
        off = ((n * w) @ p - goal) / start
        w = np.clip(w - 0.5 * (p @ off + M.PULL * (w - 1)), 0, M.MOST_RATE)
    return (n * w) @ p


def test_targets_are_met(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labelled = table(spark, sf, "labels").select("doc_id", M.label_domain().alias("domain"))
    rows = M.mix(docs, labelled).collect()
    assert len(rows) == docs.count()
    assert all(r["rate"] >= 0 and abs(sum(r[f"p_{d}"] for d in M.TARGETS) - 1) < 1e-9 and abs(r["copies"] - r["rate"]) < 1 for r in rows)
    want = brute(rows)
    for k, (d, share) in enumerate(totals(rows).items()):
        assert abs(share - want[k]) < 0.003


def test_fit_equals_brute_force(spark):
    """On two pure domains the rates are the ratios of target and share."""
    rows = [(i, 100, float(i % 4 == 0), float(i % 4 != 0)) for i in range(40)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_a double, p_b double")
    got = M.fit_rates(members, {"a": 1.0, "b": 1.0}).collect()
    assert all(abs(r["rate"] - (2.0 if r["p_a"] else 2 / 3)) < 0.01 for r in got)
    none = M.fit_rates(members.withColumn("n_tokens", F.lit(0)), {"a": 1.0, "b": 1.0})
    assert {r["rate"] for r in none.collect()} == {1.0}


def test_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert M.mix(odd_docs, none).count() == odd_docs.count()
    assert M.mix(odd_docs.limit(0), none).count() == 0
    applied = M.apply_mix(odd_docs, none)
    assert applied.columns == odd_docs.columns and applied.count() > 0
    labels = spark.createDataFrame([(1, "good"), (1, "toxic"), (None, "good"), (99, "low"), (3, "other")], "doc_id long, domain string")
    assert M.mix(odd_docs, labels).count() == odd_docs.count()


def fitted(spark, rows, targets):
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double")
    got = M.fit_rates(members, targets).collect()
    assert min(r["rate"] for r in got) >= 0
    return totals(got)


def test_totals_meet_the_targets_themselves(spark):
    """Domains far under an eighth of their target, of sharp and of soft posteriors."""
    rare = [(i, 100, 1.0, 0.0, 0.0) if i < 900 else (i, 100, 0.0, 1.0, 0.0) for i in range(999)] + [(999, 100, 0.0, 0.0, 1.0)]
    hot = [(i, 100, 0.9, 0.08, 0.02) if i < 50 else (i, 100, 0.02, 0.97, 0.01) for i in range(995)] + [(i, 100, 0.1, 0.1, 0.8) for i in range(995, 1000)]
    for rows in (rare, hot):
        for d, x in fitted(spark, rows, M.TARGETS).items():
            assert abs(x - M.TARGETS[d]) <= 0.01 * M.TARGETS[d], (d, x)


def test_unmet_targets_are_told(spark):
    import pytest

    with pytest.warns(UserWarning, match="toxic"):
        fitted(spark, [(i, 100, 0.5, 0.5, 0.0) for i in range(10)], M.TARGETS)


def test_clean_documents_stay(spark, make_docs):
    """Good tokens over their target: rates under one drop none of the documents to keep."""
    good = [f"river stone garden window number{i}" for i in range(190)]
    docs = make_docs(good + ["buy cheap pills now click"] * 10)
    labels = spark.createDataFrame([(i, "good" if i < 190 else "low") for i in range(200)], "doc_id long, domain string")
    targets = {"good": 0.5, "low": 0.5}
    kept = {r["doc_id"] for r in M.apply_mix(docs, labels, targets, keep="good").collect()}
    assert kept >= set(range(190))
    assert not {r["doc_id"] for r in M.apply_mix(docs, labels, targets).collect()} >= set(range(190))
