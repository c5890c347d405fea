from collections import Counter, defaultdict

from chronoweave.operators import motifs as MO
from chronoweave.sources import testdata as T


def test_all_documents_against_brute_force(spark, sf):
    edges = T.mixed_edges(spark, sf).where("doc < 60").cache()
    steps, kinds, want, atoms = defaultdict(dict), {}, set(), Counter()
    for r in MO.closure(edges).collect():
        steps[r["doc"], r["u"]][r["v"]] = r["o"]
        kinds[r["doc"], r["v"]] = r["kv"]
    for d, s, t, k in edges.select("doc", "s", "t", "kind").distinct().collect():
        two, three = defaultdict(list), defaultdict(list)
        for m, o1 in sorted(steps[d, s].items()):
            if t in steps[d, m]:
                two[f"{k}3{kinds[d, m]}"].append((m, o1, steps[d, m][t]))
            for y, o2 in sorted(steps[d, m].items()):
                if m != t and y not in (s, t) and t in steps[d, y]:
                    three[f"{k}4{kinds[d, m]}{kinds[d, y]}"].append((m, y, o1, o2, steps[d, y][t]))
        want |= {(d, s, t, f, *x) for f, found in three.items() for x in found[:4]}
        atoms.update({f"GRAPH|{f}|" + ">".join(x[1:]) for f, found in two.items() for x in found[:4]} | {f"GRAPH|{f}|" + ">".join(x[2:]) for f, found in three.items() for x in found[:4]})
    got = MO.three_hop(edges).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len({x[3] for x in want}) > 4
    both = MO.graph_atoms(MO.two_hop(edges)).unionByName(MO.graph_atoms(MO.three_hop(edges)))
    assert {r["atom"]: r["count"] for r in both.groupBy("atom").count().collect()} == atoms
