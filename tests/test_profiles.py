"""Counts of distinct sets stand for their instances."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import atoms as A
from chronoweave.operators import combining as CB
from chronoweave.operators import metrics as ME
from chronoweave.operators import mining as MN
from chronoweave.operators import verify as VF

SETS = "view string, sig string, doc long, s long, t long, rel string, have array<string>"


@pytest.fixture(scope="module")
def rows():
    """Many instances of few sets: some of one document, some of all, an empty one, names with odd characters."""
    kinds = [["a", "b", "c|d"], ["a", "c|d"], ["b"], [], ["a", "b", "c|d", "e & f"]]
    return [("v", "", i % 7 if i % 3 else 99, i, i + 1, "X" if i % 4 == 0 else "Y" if i % 4 == 1 else "Z", kinds[i * i % 5]) for i in range(400)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pair_supports(spark, rows):
    sets = spark.createDataFrame(rows, SETS)
    k, n, docs = Counter(), Counter(), defaultdict(set)
    one, seen = Counter(), defaultdict(set)
    for _, _, doc, _, _, rel, have in rows:
        for a in have:
            one[rel, a] += 1
            seen[rel, a].add(doc)
        for p in combinations(sorted(have), 2):
            k[rel, *p] += 1
            n[p] += 1
            docs[rel, *p].add(doc)
    singles = MN.single_supports(sets, ["X", "Y"])
    assert {(r["rel"], r["atom"]): (r["k"], r["docs"]) for r in singles.collect()} == {x: (c, len(seen[x])) for x, c in one.items() if x[0] != "Z"}
    long = sets.select(*sets.columns[:-1], F.explode("have").alias("atom"))
    for atoms in (sets, long):
        got = MN.pair_supports(atoms, singles, 3, 2, ["X", "Y"]).collect()
        want = {x: (n[x[1:]], c, len(docs[x])) for x, c in k.items() if c >= 3 and len(docs[x]) >= 2 and x[0] != "Z"}
        assert {(r["rel"], r["a"], r["b"]): (r["n"], r["k"], r["docs"]) for r in got} == want


def test_rare_conjunctions(spark, rows):
    got = MN.rare_conjunctions(spark.createDataFrame(rows, SETS), "X", least_n=1, least_k=2, least_docs=1).collect()
    n, k, docs = Counter(), Counter(), defaultdict(set)
    for _, _, doc, _, _, rel, have in rows:
        for c in (c for size in (1, 2, 3) for c in combinations(sorted(have), size)):
            n[c] += 1
            if rel == "X":
                k[c] += 1
                docs[c].add(doc)
    assert {r["conds"]: (r["n"], r["k"], r["docs"]) for r in got} == {" & ".join(c): (n[c], m, len(docs[c])) for c, m in k.items() if m >= 2}


def test_instances_stay_where_they_are(spark, rows):
    """Rules are looked up beside each instance: no instance or atom is shuffled."""
    sets = spark.createDataFrame(rows, SETS)
    conds = spark.createDataFrame([(1, "v", "", "a", 2), (1, "v", "", "b", 2), (2, "v", "", "e & f", 1)], "rule_id long, view string, sig string, cond string, n_conds long")
    for fired in (MN.firing(sets, conds), MN.firing_by_rarest(sets, conds)):
        assert "SortMergeJoin" not in plan(fired) and "hashpartitioning(doc" not in plan(fired)
        want = {(r[2], r[3], r[4], i) for r in rows for i, need in ((1, {"a", "b"}), (2, {"e & f"})) if need <= set(r[6])}
        found = [(r["doc"], r["s"], r["t"], r["rule_id"]) for r in fired.collect()]
        assert set(found) == want and len(found) == len(want)


def test_weights(spark):
    scores = spark.createDataFrame([(i, "X", float(i // 3)) for i in range(10)] + [(0, "Y", 1.0)], "s long, rel string, score double")
    assert sorted((r["rel"], r["s"]) for r in CB.top_share(scores, 0.5).collect()) == [("X", 3), ("X", 4), ("X", 5), ("X", 6), ("X", 7), ("X", 8), ("X", 9), ("Y", 0)]
    both = spark.createDataFrame([("a", "b", 5), ("a", "b", 2), ("b", "b", 1)], "gold string, pred string, c long")
    assert {tuple(r) for r in ME.confusion(both).collect()} == {("a", "b", 7), ("b", "b", 1)}
    fired = spark.createDataFrame([(1, 1, 2, "X", 10, 4), (1, 1, 2, "X", 11, 4), (1, 3, 4, "X", 10, 1)], "doc long, s long, t long, rel string, rule_id long, c long")
    assert [tuple(r) for r in CB.near_rules(fired, 0.5).collect()] == [(10, 11, 0.8)]


def test_labels_of_pairs(spark):
    rows = [(1, 5, 6, "A"), (1, 5, 6, "B"), (1, 5, 6, "B"), (1, 6, 5, "A"), (2, 5, 6, "A"), (2, 6, 5, None), (3, 5, 5, "A"), (3, 5, 5, None)]
    edges = spark.createDataFrame(rows, "doc long, s long, t long, rel string")
    assert [r["what"] for r in VF.two_labels(edges).collect()] == ["5|6|2"]
    assert sorted((r["doc"], r["what"]) for r in VF.opposite_labels(edges).collect()) == [("1", "5|6|A"), ("1", "5|6|B"), ("1", "5|6|B"), ("2", "5|6|A")]
    for df in (VF.two_labels(edges), VF.opposite_labels(edges)):
        assert "HashAggregate" not in plan(df) and "Join" not in plan(df)


def test_texts_are_read_before_they_are_paired(spark, sf):
    """A text's shape and date are found once for a time expression and not for each of its pairs."""
    from chronoweave.sources import testdata as T

    tx = T.timexes(spark, sf).where("doc < 20")
    text = A.timex_pair_atoms(tx)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in text.split("Join")[0].upper() and "regexp" not in text.split("Join")[0]
    assert A.timex_pair_atoms(tx).select("doc", "a", "b").distinct().count() == tx.alias("x").join(tx.alias("y"), "doc").where("x.tx < y.tx").count()
