"""Triangles and paths inside documents against joins and loops."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import allen as AL
from chronoweave.operators import documents as D
from chronoweave.operators import energy as EN
from chronoweave.operators import motifs as MO
from chronoweave.sources import testdata as T

EDGES = "doc long, s long, t long, kind string, rel string"


@pytest.fixture(scope="module")
def edges(spark, sf):
    return spark.createDataFrame(T.mixed_edges(spark, sf).where("doc < 40").collect(), EDGES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_move_once(edges):
    """No triangle, path or label of an edge is joined or shuffled; an edge goes to its document's task once."""
    prior = EN.label_prior(edges)
    tables = prior, EN.channel_injected(prior, 0.1), EN.triangle_information(MO.configuration_counts(edges), prior)
    swept = EN.edge_energies(edges.withColumn("gold", F.col("rel")), *tables, "gold").select("gold", "obs", EN.best_option())
    for df in (MO.two_hop(edges), MO.three_hop(edges), MO.motif_atoms(edges), AL.edge_states(edges), swept):
        assert "SortMergeJoin" not in plan(df) and plan(df).count("hashpartitioning(doc") == 1


def test_counts_of_triangles(edges):
    repeated = edges.unionByName(edges.where("s % 3 = 0"))
    for e in (edges, repeated):
        want = Counter({tuple(r)[:4]: r["n"] for r in MO.configurations(MO.triangles(e)).collect()})
        assert Counter({tuple(r)[:4]: r["n"] for r in MO.configuration_counts(e).collect()}) == want
    folds = MO.configuration_counts(edges.withColumn("fold", F.col("doc") % 3), "fold").collect()
    assert sum(r["n"] for r in folds) == MO.triangles(edges).count() and {r["fold"] for r in folds} == {0, 1, 2}


@pytest.mark.parametrize("wedges", [1, 7, 1_000_000])
def test_parts_of_a_document(edges, monkeypatch, wedges):
    """However few wedges are formed at a time, the triangles and paths are the same."""
    rows = pa.Table.from_pandas(edges.where("doc < 12").orderBy("doc", "s", "t").toPandas())
    monkeypatch.setattr(D, "BATCH_WEDGES", wedges)
    g = D.Graph(rows)
    found = Counter((int(g.lo[xy]), int(g.hi[xy]), int(g.hi[yz])) for part in g.triangles() for xy, yz, xz in zip(*part))
    monkeypatch.setattr(D, "BATCH_WEDGES", 10**9)
    whole = Counter((int(g.lo[xy]), int(g.hi[xy]), int(g.hi[yz])) for part in g.triangles() for xy, yz, xz in zip(*part))
    assert found == whole and set(found.values()) == {1}
    g.close()
    pairs, _ = g.pairs()
    many = sum(len(x[0]) for x in g.two_hops(pairs))
    monkeypatch.setattr(D, "BATCH_WEDGES", wedges)
    assert sum(len(x[0]) for x in g.two_hops(pairs)) == many
    assert sorted(i for part in g.by_end(pairs) for i in part) == list(range(len(pairs)))


def test_no_path_is_left_out(spark):
    """Six nodes between two ends, the last with labels of its own: a cap of four loses its atoms."""
    rows = [(1, 100, 200, "EE", "BEFORE")]
    for m in range(1, 7):
        rel = "CONTAINS" if m == 6 else "BEFORE"
        rows += [(1, 100, m, "EE", rel), (1, m, 200, "EE", rel)]
    rows += [(1, a, b, "EE", "OVERLAP" if b == 6 else "BEFORE") for a in range(1, 7) for b in range(a + 1, 7)]
    e = spark.createDataFrame(rows, EDGES)
    steps = {(u, v): o for u, v, o in ((r["u"], r["v"], r["o"]) for r in MO.closure(e).collect())}
    nodes = {u for u, _ in steps}
    want = Counter()
    for _, s, t, k, _ in rows:
        atoms = {f"GRAPH|{k}3E|{steps[s, m]}>{steps[m, t]}" for m in nodes if (s, m) in steps and (m, t) in steps}
        atoms |= {f"GRAPH|{k}4EE|{steps[s, m]}>{steps[m, y]}>{steps[y, t]}" for m in nodes for y in nodes if (s, m) in steps and (m, y) in steps and (y, t) in steps and m != t and y not in (s, t)}
        want.update(atoms)
    assert {r["atom"]: r["n"] for r in MO.path_atom_counts(e).collect()} == want
    capped = {r["atom"] for r in MO.graph_atoms(MO.two_hop(e)).where("s = 100 and t = 200").collect()}
    assert "GRAPH|EE3E|CONTAINS>CONTAINS" in want and "GRAPH|EE3E|CONTAINS>CONTAINS" not in capped


def test_atoms_of_an_edge(edges):
    rows = edges.withColumn("gold", F.col("rel"))
    got = {(r["doc"], r["s"], r["t"], a) for r in MO.motif_atoms(rows, 4, "gold").collect() for a in r["atoms"]}
    assert got == {tuple(r) for r in MO.graph_atoms(MO.two_hop(edges)).collect()}


def test_names_as_nodes(spark):
    """Documents and nodes may be names."""
    rows = [("d", a, b, "EE", "BEFORE") for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d"))]
    e = spark.createDataFrame(rows, "doc string, s string, t string, kind string, rel string")
    assert sorted(r["m"] for r in MO.two_hop(e).where("s = 'a' and t = 'c'").collect()) == ["b", "d"]
    assert [(r["m"], r["y"]) for r in MO.three_hop(e).where("s = 'a' and t = 'd'").collect()] == [("b", "c")]
    assert MO.two_hop(e.limit(0)).count() == 0
