"""Brute force, known constants and properties that must hold."""

import json
import zipfile
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.functions import vocabulary as V
from chronoweave.operators import allen as AL
from chronoweave.operators import combining as CB
from chronoweave.operators import energy as EN
from chronoweave.operators import graph as G
from chronoweave.operators import metrics as ME
from chronoweave.operators import mining as MN
from chronoweave.operators import motifs as MO
from chronoweave.operators import noise as NZ
from chronoweave.sources import files

EDGES = "doc long, s long, t long, rel string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wilson_constants(spark):
    for k, want in ((12, 0.757506), (25, 0.866808), (10, 0.722467)):
        assert round(one(spark, S.wilson_lower(F.lit(k), F.lit(k))), 6) == want
    assert one(spark, S.wilson_lower(F.lit(0), F.lit(0))) == 0.0


def test_least_support():
    z2 = V.Z_EXACT**2
    for target in (0.3, 0.5, 0.72):
        k = S.least_support(target)
        assert 1 / (1 + z2 / k) >= target and (k == 1 or 1 / (1 + z2 / (k - 1)) < target)


def test_erfc(spark):
    import math

    xs = [i / 50 for i in range(400)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - math.erfc(r["x"])) <= 1.3e-7 * math.erfc(r["x"]) for r in got)


def test_md5_mod(spark):
    import hashlib

    names = [f"d{i}" for i in range(200)]
    for m in (2, 3, 5, 10):
        got = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.md5_mod(F.col("n"), m).alias("m")).collect()
        assert all(r["m"] == int(hashlib.md5(r["n"].encode()).hexdigest(), 16) % m for r in got)


def test_symmetric_duplicates(spark):
    edges = spark.createDataFrame([(1, 5, 4, "BEGINS-ON"), (1, 4, 5, "BEGINS-ON"), (1, 4, 6, "BEFORE"), (1, 4, 4, "BEFORE"), (1, 4, 9, "BEFORE")], EDGES)
    nodes = spark.createDataFrame([(1, 4), (1, 5), (1, 6)], "doc long, ev long")
    assert sorted(map(tuple, G.relation_edges(edges, nodes).collect())) == [(1, 4, 5, "BEGINS-ON"), (1, 4, 6, "BEFORE")]


def test_mixed_anchors(spark):
    edges = spark.createDataFrame([(1, 1, "E", "A", "entity"), (1, 2, "E", "B", "entity"), (1, 1, "S", "A", "span"), (1, 2, "S", "A", "span"), (1, 3, "X", "A", "span")], "doc long, s long, anchor string, role string, strength string")
    at = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 4, 1), (1, 3, 0, 0)], "doc long, ev long, sent long, tok long")
    (row,) = G.anchored_pairs(edges, at).collect()
    assert (row["n_anchors"], row["anchors"], row["roles"], row["strength"], row["sdist"], row["torder"]) == (2, "E,S", "A/A,A/B", "mixed", 4, "fwd")


def test_allen_table(spark):
    table = AL.composition_table()
    assert len(table) == 169 and sum(map(len, table.values())) == 409
    assert {tuple(r) for r in AL.compositions(spark).collect()} == {(a, b, c) for (a, b), v in table.items() for c in v}


def test_consistency():
    assert not AL.inconsistent("BEFORE", "BEFORE", "ENDS-ON") and AL.inconsistent("BEFORE", "BEFORE", "OVERLAP")
    assert AL.inconsistent("CONTAINS", "iCONTAINS", "BEFORE") and not AL.inconsistent("iCONTAINS", "CONTAINS", "BEFORE")
    assert AL.inconsistent("CONTAINS", "OVERLAP", "BEFORE")


def brute_triangles(edges):
    at = {(d, min(s, t), max(s, t)): (s > t, r) for d, s, t, r in edges}
    nodes = {}
    for d, a, b in at:
        nodes.setdefault(d, set()).update((a, b))
    out = []
    for d, ns in nodes.items():
        for x, y, z in combinations(sorted(ns), 3):
            if all((d, *p) in at for p in ((x, y), (y, z), (x, z))):
                out.append((d, x, y, z))
    return sorted(out)


@pytest.fixture(scope="module")
def small_edges(spark, sf):
    from chronoweave.sources import testdata as T

    return T.edges(spark, sf).where("doc < 40").cache()


def test_triangles(small_edges):
    rows = [tuple(r) for r in small_edges.collect()]
    assert sorted((r["doc"], r["x"], r["y"], r["z"]) for r in MO.triangles(small_edges).collect()) == brute_triangles(rows)


def test_true_labels_are_consistent(small_edges):
    assert AL.conflicts(MO.triangles(small_edges)).count() == 0


def test_firing_two_ways(spark, sf):
    from chronoweave.plans import rule_plans as R

    _, conds = R.library(spark)
    atoms = R.mined_atoms(spark, sf).where("doc < 60")
    x, y = MN.firing(atoms, conds), MN.firing_by_rarest(atoms, conds)
    key = ["doc", "s", "t", "rule_id"]
    assert {tuple(r) for r in x.select(*key).collect()} == {tuple(r) for r in y.select(*key).collect()}


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    import math

    rules = spark.createDataFrame([("", "", "R", f"c{i}", math.log10(x)) for i, x in enumerate(p)], "view string, sig string, rel string, conds string, logp double")
    up = {r["conds"] for r in MN.benjamini_hochberg(rules, 0.05).collect()}
    point = {r["conds"] for r in MN.benjamini_hochberg(rules, 0.05, step_up=False).collect()}
    assert up == {"c0", "c1"} and point == {"c0", "c1"}
    looser = {r["conds"] for r in MN.benjamini_hochberg(rules, 0.07).collect()}
    assert looser == {"c0", "c1", "c2", "c3", "c4"}


def test_beam_equals_exhaustive(spark, sf):
    from chronoweave.plans.mining_plans import mined_atoms

    atoms = mined_atoms(spark, sf).where("doc < 150").cache()
    sets = {}
    for r in atoms.collect():
        sets.setdefault((r["doc"], r["s"], r["t"], r["rel"]), set()).add(r["atom"])
    names = sorted({a for v in sets.values() for a in v})
    want = {}
    for size in (1, 2):
        for c in combinations(names, size):
            if len({x.split("|")[1] for x in c}) < size:
                continue
            n = sum(set(c) <= v for v in sets.values())
            k = sum(set(c) <= v and key[3] == "CONTAINS" for key, v in sets.items())
            if n >= 25 and k >= 5:
                want[" & ".join(c)] = (n, k)
    got = {r["conds"]: (r["n"], r["k"]) for r in MN.beam_search(atoms, "CONTAINS", depth=2, beam=10_000).collect()}
    assert got == want


def test_cover():
    kept, bound = CB.cover([["r1"], ["r1", "r2"], ["r2", "r3"], ["r3"]])
    assert kept == ["r1", "r3"] and bound == 2


def test_extension_representatives_keep_predictions(spark, sf):
    """One rule of each extension class is enough for its label's strongest weight to be a weight of the class."""
    from chronoweave.plans import rule_plans as R

    f = R.fired(spark, sf).cache()
    assert CB.extension_classes(f).agg(F.sum("n_rules")).first()[0] == f.select("rule_id").distinct().count()
    kept = CB.constraint_sets(CB.strongest_per_label(f), f)
    before = CB.best_label(CB.strongest_per_label(f).withColumnRenamed("w", "score")).select("doc", "s", "t", "pred")
    cover, _ = CB.cover([r["rules"] for r in CB.distinct_constraints(kept).collect()])
    g = f.where(F.col("rule_id").isin(cover))
    after = CB.best_label(CB.strongest_per_label(g).withColumnRenamed("w", "score")).select("doc", "s", "t", "pred")
    assert before.exceptAll(after).count() == 0


def test_macro_counts_absent_labels(spark):
    rows = spark.createDataFrame([("BEFORE", "BEFORE", 8), ("CONTAINS", "BEFORE", 2)], "gold string, pred string, n long")
    assert abs(ME.summary(rows).first()["macro_f1"] - (16 / 18) / 6) < 1e-12


def brute_icm(rows, q, c, pmi, weight):
    """Recomputes the whole energy of the document's triangles for each choice; rows are ``(s, t, kind, observed)``."""
    import math

    order = sorted(rows)
    at = {(min(r[:2]), max(r[:2])): j for j, r in enumerate(order)}
    rev = [r[0] > r[1] for r in order]
    kind_of = {}
    for s, t, kind, _ in order:
        kind_of[s], kind_of[t] = kind
    nodes = sorted(kind_of)
    tri = [((x, y, z), (at[x, y], at[y, z], at[x, z])) for x, y, z in combinations(nodes, 3) if (x, y) in at and (y, z) in at and (x, z) in at]

    o = lambda l, r: l if not r or l in V.SYMMETRIC else f"i{l}"
    label = [r[3] for r in order]
    score = lambda lab, t: pmi[("".join(kind_of[n] for n in t[0]), *(o(lab[j], rev[j]) for j in t[1]))]

    def energy(j, cand):
        lab = list(label)
        lab[j] = cand
        mine = [t for t in tri if j in t[1]]
        kind, seen = order[j][2:]
        return round(-math.log(q[kind, cand]) - c[kind, seen, cand] + (weight * sum(-score(lab, t) for t in mine) / len(mine) if mine else 0.0), 9)

    todo = sorted({j for t in tri if score(label, t) < 0 for j in t[1]})
    for _ in range(4):
        again = set()
        for j in todo:
            choices = [(energy(j, cand), i, cand) for i, cand in enumerate(V.RELATIONS) if cand == label[j] or q[order[j][2], cand] >= 1e-4]
            least, _, best = min(choices)
            if least < energy(j, label[j]):
                label[j] = best
                again |= {i for t in tri if j in t[1] for i in t[1] if i != j}
        todo = sorted(again)
        if not todo:
            break
    return {r[:2]: x for r, x in zip(order, label)}


@pytest.mark.parametrize("documents_side_by_side", [1, 100_000])
def test_icm(spark, sf, monkeypatch, documents_side_by_side):
    from chronoweave.sources import testdata as T

    monkeypatch.setattr(EN, "BATCH_EDGES", documents_side_by_side)
    edges = T.mixed_edges(spark, sf).where("doc < 30").cache()
    prior = EN.label_prior(edges)
    assert {r["kind"] for r in prior.collect()} == {"EE", "ET", "TE", "TT"}
    information = EN.triangle_information(MO.triangles(edges), prior)
    channel = EN.channel_injected(prior, 0.1)
    noisy = NZ.inject(edges.where("doc < 12"), prior, 0.2).select("doc", "s", "t", "kind", F.col("obs").alias("rel"))
    got = {}
    for r in EN.icm_repair(noisy, prior, channel, information).collect():
        got.setdefault(r["doc"], {})[r["s"], r["t"]] = r["best"]
    q = {(r["kind"], r["rel"]): r["q"] for r in prior.collect()}
    c = {(r["kind"], r["obs"], r["rel"]): r["log_p"] for r in channel.collect()}
    pmi = {(r["kinds"], r["o_xy"], r["o_yz"], r["o_xz"]): r["pmi"] for r in information.collect()}
    docs = {}
    for r in noisy.collect():
        docs.setdefault(r["doc"], []).append((r["s"], r["t"], r["kind"], r["rel"]))
    assert got == {d: brute_icm(rows, q, c, pmi, 0.5) for d, rows in docs.items()}
    assert any(x != rows[k] for d, rows in ((d, {r[:2]: r[3] for r in v}) for d, v in docs.items()) for k, x in got[d].items())


def test_icm_odd_rows(spark, small_edges):
    """Rows that cannot be repaired are left out, a loop and a repeated pair are no triangles, a kind without tables counts as EE."""
    prior = EN.label_prior(small_edges)
    tables = prior, EN.channel_injected(prior, 0.1), EN.triangle_information(MO.triangles(small_edges), prior)
    rows = [(1, 1, 2, "BEFORE"), (1, 2, 3, "BEFORE"), (1, 1, 3, "BEFORE"), (1, 3, 1, "CONTAINS"), (1, 2, 2, "BEFORE"), (None, 1, 2, "BEFORE"), (2, 1, 2, None), (2, 1, 2, "NEAR"), (3, 5, 6, "OVERLAP")]
    df = spark.createDataFrame(rows, EDGES)
    assert EN.icm_repair(df, *tables).count() == 6
    assert EN.icm_repair(df.withColumn("kind", F.lit("XY")).limit(0), *tables).count() == 0
    assert EN.icm_repair(df.withColumn("kind", F.lit("TT")), *tables).count() == 6


def test_grid_search_counts_as_repair_does(spark, sf):
    from chronoweave.plans import repair_plans as R

    rows = R.injected(spark, sf)
    tables = R._tables(rows)
    found = {(r["weight"], r["damping"], r["mean"]): (r["fixed"], r["broken"]) for r in EN.grid_search(rows, *tables, [(0.5, 0.0, True), (0.1, 0.5, False)]).collect()}
    for (weight, damping, mean), want in found.items():
        fixed = EN.icm_repair(rows, *tables, weight=weight, damping=damping, mean=mean).join(rows.select("doc", "s", "t", "gold"), ["doc", "s", "t"])
        assert ME.repair_score(fixed.select("gold", "obs", F.col("best").alias("fin"))).select("fixed", "broken").first() == want


def test_bootstrap(spark, sf):
    """Equal sides differ by nothing; a side that is plainly better has an interval above zero, near the normal one."""
    from chronoweave.plans import repair_plans as R

    rows = R.injected(spark, sf)
    clean = NZ.document_confusions(rows.select("doc", "gold", F.col("gold").alias("pred")))
    noisy = NZ.document_confusions(rows.withColumnRenamed("rel", "pred"))
    assert tuple(NZ.paired_bootstrap(noisy, noisy, resamples=500).first()) == (0.0, 0.0, 0.0, 1.0)
    row = NZ.paired_bootstrap(clean, noisy, resamples=2_000).first()
    assert 0 < row["lo"] < row["diff"] < row["hi"] < 1 and row["p"] < 0.01
    import numpy as np

    drawn = NZ.poisson_one(np.arange(1, 200_001, dtype=np.uint64) * np.uint64(7919), np.uint64(3))
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02


def test_false_alarms_and_cross_fit(spark, sf):
    from chronoweave.plans.registry import QUERIES

    quiet = QUERIES["me_false_alarms"](spark, sf).first()
    assert quiet["wrong_before"] == 0 and quiet["fixed"] == 0 and quiet["flagged"] == quiet["broken"] < 0.02 * quiet["n"]
    steps = {r["step"]: r for r in QUERIES["au_cross_fit"](spark, sf).collect()}
    assert steps["observed"]["wrong_after"] == steps["observed"]["wrong_before"]
    assert steps["repaired"]["wrong_after"] < steps["observed"]["wrong_after"]


def test_repair_helps(spark, sf):
    from chronoweave.plans.repair_plans import repaired

    row = ME.repair_score(repaired(spark, sf).select("gold", "obs", F.col("best").alias("fin"))).first()
    assert row["wrong_after"] < row["wrong_before"] and row["net"] > 0


def test_noise_is_deterministic_and_near_its_rate(spark, sf):
    from chronoweave.sources import testdata as T

    e = T.edges(spark, sf)
    prior = EN.label_prior(e)
    a, b = (NZ.inject(e.repartition(n), prior, 0.1) for n in (2, 5))
    assert a.exceptAll(b).count() == 0
    share = a.agg(F.avg((F.col("obs") != F.col("rel")).cast("int"))).first()[0]
    assert 0.08 < share < 0.12


def test_files(spark, tmp_path):
    doc = {"id": "d1", "title": "t", "tokens": [["a"]], "events": [{"id": "e1", "type": "T", "type_id": 1, "mention": [{"id": "m", "trigger_word": "w", "sent_id": 0, "offset": [0, 1]}]}], "TIMEX": [], "temporal_relations": {"BEFORE": [["e1", "e2"]]}, "causal_relations": {}, "subevent_relations": [["e1", "e2"]]}
    other = {**doc, "id": "d2", "subevent_relations": {"x": [["e3", "e4"]]}}
    (tmp_path / "docs.jsonl").write_text(json.dumps(doc) + "\n\n" + json.dumps(other) + "\n")
    docs = files.read_event_documents(spark, str(tmp_path / "docs.jsonl"))
    assert docs.count() == 2 and files.relations_of(docs).where("doc = 'd1'").first()["rel"] == "BEFORE"
    pairs = {r["id"]: r["p"] for r in docs.select("id", files.subevent_pairs(F.col("subevent_relations")).alias("p")).collect()}
    assert pairs == {"d1": [["e1", "e2"]], "d2": [["e3", "e4"]]}
    arg = [{"id": "a", "entities": [], "events": []}, {"id": "a", "entities": [{"id": "x", "type": "t", "mention": []}], "events": []}]
    with zipfile.ZipFile(tmp_path / "arg.zip", "w") as z:
        z.writestr("train.jsonl", "\n".join(map(json.dumps, arg)))
    (row,) = files.read_argument_archive(spark, str(tmp_path / "arg.zip"), "train.jsonl").collect()
    assert row["id"] == "a" and len(row["entities"]) == 1
    (tmp_path / "m.json").write_text(json.dumps({"rate": 0.1, "n_changed": 1, "changed": [{"doc": "d", "event1": "a", "event2": "b", "fake": "BEFORE"}]}, indent=1))
    assert tuple(files.read_manifest(spark, str(tmp_path / "m.json")).first()) == (0.1, "d", "a", "b", "BEFORE")
    preds = files.parse_prediction_map(spark.createDataFrame([('{"d|a|b": "BEFORE"}',)], "value string"))
    assert tuple(preds.first()) == ("d", "a", "b", "BEFORE")
    files.write_graph({"p": preds}, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g"), ["p"])["p"].count() == 1
    assert files.read_predictions(spark, str(tmp_path / "g/p"), preds.select("doc")).count() == 1
    (tmp_path / "f.tsv").write_text("split\tdoc\ts\tt\tetype\tgold\tatoms\n0\td\ta\tb\tEE\tX\tp|q\n")
    assert files.read_features(spark, str(tmp_path / "f.tsv")).first()["atoms"] == ["p", "q"]
    text = files.render_pair(F.array(*map(F.lit, "abc")), F.lit(0), F.lit(2))
    assert one(spark, text) == "[A:a] b [B:c]"


def test_stream_equals_table(spark, small_edges, tmp_path):
    from chronoweave.streaming import repair as R

    prior = EN.label_prior(small_edges)
    tables = {"prior": prior, "channel": EN.channel_injected(prior, 0.1), "information": EN.triangle_information(MO.triangles(small_edges), prior)}
    noisy = NZ.inject(small_edges, prior, 0.2).select("doc", "s", "t", F.col("obs").alias("rel"))
    for k in range(3):
        noisy.where(F.col("doc") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}.parquet")
    R.repair_stream(R.read_edges(spark, str(tmp_path / "in"), 1), out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"), **tables).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select("doc", "s", "t", "best")
    whole = EN.icm_repair(noisy, **tables).select("doc", "s", "t", "best")
    assert streamed.exceptAll(whole).count() == 0 and whole.exceptAll(streamed).count() == 0


def _plain_macro(gold, pred):
    from chronoweave.functions import vocabulary as V

    total = 0.0
    for r in V.RELATIONS:
        hit = sum(g == p == r for g, p in zip(gold, pred))
        total += 2 * hit / (gold.count(r) + pred.count(r)) if hit else 0.0
    return total / len(V.RELATIONS)


def test_offsets_equal_a_plain_search(spark):
    import numpy as np

    from chronoweave.operators import learn

    names, rnd = ["BEFORE", "CONTAINS", "OVERLAP"], np.random.default_rng(5)
    scores = np.round(rnd.normal(size=(300, 3)) + [1.5, 0.0, 0.0], 3)
    gold = [names[i] for i in (scores + rnd.normal(size=(300, 3)) - [1.5, 0.0, 0.0]).argmax(1)]
    grid = (-1.0, 0.5, 1.0, 2.0)
    want, best = [0.0] * 3, _plain_macro(gold, [names[i] for i in scores.argmax(1)])
    for _ in range(2):
        for at in (1, 2):
            for d in grid:
                trial = [*want[:at], d, *want[at + 1 :]]
                score = _plain_macro(gold, [names[i] for i in (scores + trial).argmax(1)])
                if score > best:
                    want, best = trial, score
    rows = spark.createDataFrame([(g, list(map(float, s))) for g, s in zip(gold, scores)], "gold string, scores array<double>")
    got, macro = learn.tune_offsets(rows, names, grid, rounds=2)
    assert got == want and any(want)
    assert abs(macro - best) < 1e-12


def test_floors_from_observed_weights(spark):
    from chronoweave.operators import combining as CB

    rows = [("CONTAINS", 0.9, None, 5), ("CONTAINS", 0.4, 0.3, 3), ("BEFORE", 0.4, None, 6), ("OVERLAP", 0.2, 0.6, 4), ("BEFORE", None, 0.3, 9), ("BEFORE", None, None, 20)]
    profile = spark.createDataFrame(rows, "gold string, CONTAINS double, OVERLAP double, n long")
    labels, marks = ["CONTAINS", "OVERLAP"], {"CONTAINS": [0.2, 0.4, 0.9, 9.0], "OVERLAP": [0.3, 0.6, 9.0]}

    def score(floors):
        gold, pred = [], []
        for g, c, o, n in rows:
            can = [(-w, r) for r, w in (("CONTAINS", c), ("OVERLAP", o)) if w is not None and w >= floors[r]]
            gold += [g] * n
            pred += [min(can)[1] if can else "BEFORE"] * n
        return _plain_macro(gold, pred)

    want = dict.fromkeys(labels, 9.0)
    for _ in range(3):
        for r in labels:
            for v in marks[r]:
                if score(want | {r: v}) > score(want):
                    want = want | {r: v}
    got, best = CB.tune_floors(profile, labels, grid=None)
    assert got == want and abs(best - score(want)) < 1e-12


def test_container_rates_back_off_to_the_type(spark):
    from chronoweave.operators import atoms as A

    edges = spark.createDataFrame([(1, 1, 2, "CONTAINS")] * 15 + [(1, 1, 3, "BEFORE")] * 5 + [(1, 4, 3, "CONTAINS")], "doc long, s long, t long, rel string")
    nodes = spark.createDataFrame([(1, 1, "w", "x"), (1, 2, "v", "y"), (1, 3, "u", "y"), (1, 4, "r", "x"), (1, 5, "q", None)], "doc long, ev long, word string, type string")
    got = {r["ev"]: (r["src"], r["tgt"]) for r in A.container_rates(edges, nodes).collect()}
    mean = 16 / 42
    by_type = {"x": (16, 0, 21), "y": (0, 16, 21)}
    smooth = lambda c, n: (c + 20 * mean) / (n + 20)
    want = {1: (smooth(15, 20), smooth(0, 20)), 5: (mean, mean)}
    for ev, t in ((2, "y"), (3, "y"), (4, "x")):
        s, g, n = by_type[t]
        want[ev] = smooth(s, n), smooth(g, n)
    assert got.keys() == want.keys()
    for ev in want:
        assert all(abs(x - y) < 1e-12 for x, y in zip(got[ev], want[ev]))
