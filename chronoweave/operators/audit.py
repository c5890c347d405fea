"""The auditor: rules that mark an edge's label as wrong from its atoms and motifs, cross-fitted and followed by repair.

Edges are ``(doc, s, t, kind, gold, rel, atoms)`` with the observed label as rel; each carries its own atoms, so that nothing is joined
by edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.operators import energy as EN
from chronoweave.operators import mining as MN
from chronoweave.operators import motifs as MO
from chronoweave.operators.lineage import cut

EDGE = ["doc", "s", "t"]


def audit_rules(edges: DataFrame, least_n: int = 30, least_k: int = 10, least_docs: int = 5) -> DataFrame:
    """``(rel, atom, fix, n, k, w)``: on edges that carry rel, an atom that speaks for another label ``fix``.

    Partitions are current labels; a rule passes the adaptive gate against the share of ``fix`` in its partition.
    """
    share = edges.groupBy("rel").agg(F.count(F.lit(1)).alias("all"))
    prior = edges.where("gold <> rel").groupBy("rel", F.col("gold").alias("fix")).agg(F.count(F.lit(1)).alias("c")).join(share, "rel").select("rel", "fix", (F.col("c") / F.col("all")).alias("p"))
    rows = edges.select("doc", "gold", "rel", F.explode("atoms").alias("atom"))
    n = rows.groupBy("rel", "atom").agg(F.count(F.lit(1)).alias("n"))
    k = rows.where("gold <> rel").groupBy("rel", "atom", F.col("gold").alias("fix")).agg(F.count(F.lit(1)).alias("k"), F.count_distinct("doc").alias("docs"))
    found = k.where((F.col("k") >= least_k) & (F.col("docs") >= least_docs)).join(n, ["rel", "atom"]).where(F.col("n") >= least_n).join(prior, ["rel", "fix"])
    return found.where(MN.adaptive_gate(F.col("k"), F.col("n"), F.col("p"))).select("rel", "atom", "fix", "n", "k", S.wilson_lower(F.col("k"), F.col("n")).alias("w"))


def strongest(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """``edges`` without atoms and with ``fix`` and ``w`` of the strongest rule that fires on each, null where none does.

    Rules are labels by atoms of a closed set of paths, so they are a table; weights are compared to nine decimals, ties go to
    the label first by name.
    """
    found = sorted(rules.select("rel", "atom", "fix", "w").collect(), key=lambda r: (-round(r["w"], 9), r["fix"]))
    place: dict[tuple[str, str], int] = {}
    for i, r in enumerate(found):
        place.setdefault((r["rel"], r["atom"]), i)
    fixes, weights = [r["fix"] for r in found], [r["w"] for r in found]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("rel").dictionary_encode()
            atoms = batch.column("atoms").flatten().dictionary_encode()
            table = np.array([[place.get((r, a), len(found)) for a in atoms.dictionary.to_pylist()] for r in labels.dictionary.to_pylist()], np.int64).reshape(len(labels.dictionary), len(atoms.dictionary))
            row = pc.list_parent_indices(batch.column("atoms")).to_numpy()
            best = np.full(batch.num_rows, len(found))
            np.minimum.at(best, row, table[labels.indices.to_numpy()[row], atoms.indices.to_numpy()])
            at = pa.array(best, mask=best == len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fixes, pa.string()).take(at), pa.array(weights, pa.float64()).take(at)], names=[*names, "fix", "w"])

    names, types = [c for c in edges.columns if c != "atoms"], dict(edges.dtypes)
    return edges.mapInArrow(each, ", ".join([*(f"{c} {types[c]}" for c in names), "fix string, w double"]))


def audited(floor: float) -> Column:
    """The label of ``strongest``'s rule where it reaches the floor, else the observed one."""
    return F.when(F.col("w") >= floor, F.col("fix")).otherwise(F.col("rel"))


def with_motif_atoms(edges: DataFrame) -> DataFrame:
    """``(doc, s, t, kind, rel, gold, atoms)``: atoms of the labels on the first paths of two edges between an edge's ends."""
    return MO.motif_atoms(edges, 4, "gold")


def pick_floor(best: DataFrame, grid: tuple[float, ...]) -> float:
    """The floor with the most edges set right less those set wrong; the larger floor on ties.  ``best`` is ``strongest``'s rows."""
    net = lambda x: F.count_if((x != F.col("rel")) & (x == F.col("gold"))) - F.count_if((x != F.col("rel")) & (F.col("rel") == F.col("gold")))
    floors = sorted(grid, reverse=True)
    nets = best.agg(*[net(audited(floor)).alias(f"n{i}") for i, floor in enumerate(floors)]).first()
    most, chosen = 0, max(grid)
    for n, floor in zip(nets, floors):
        if n > most:
            most, chosen = n, floor
    return chosen


def cross_fit(edges: DataFrame, information: DataFrame, prior: DataFrame, grid: tuple[float, ...] = (0.3, 0.5, 0.7, 9.0), weight: float = 0.5) -> DataFrame:
    """``(doc, s, t, gold, rel, audited, repaired)``: every edge is audited and repaired by what the other fold taught.

    In each of two folds by document, rules come from two thirds of the other fold and the floor and the noise channel from
    its last third.
    """
    fold, third = S.hash_fold(F.col("doc"), "cf", 2), S.hash_fold(F.col("doc"), "in3", 3)
    out = []
    for k in range(2):
        teach, own = edges.where(fold != k), edges.where(fold == k)
        rules = audit_rules(teach.where(third != 2))
        checked = cut(strongest(edges.where((fold == k) | (third == 2)), rules).withColumn("own", fold == k))
        tune = checked.where("not own")
        floor = pick_floor(tune, grid)
        channel = cut(EN.channel_confusion(tune.select("kind", audited(floor).alias("obs"), F.col("gold").alias("rel"))))
        own = checked.where("own").withColumn("audited", audited(floor))
        fixed = EN.icm_repair(own.withColumnsRenamed({"rel": "observed", "audited": "rel"}), prior, channel, information, weight=weight, keep=("gold", "observed"))
        out.append(fixed.select(*EDGE, "gold", F.col("observed").alias("rel"), F.col("obs").alias("audited"), F.col("best").alias("repaired")))
    return out[0].unionByName(out[1])
