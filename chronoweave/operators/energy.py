"""Energies of labels: prior, noise channel and triangle information, and their repair.

Edges are ``(doc, s, t, rel)`` with ``kind``, the kinds of start and end (EE, ET, TE, TT); where it is missing they count as event
pairs.  Priors and channels are one for each kind of edge, triangle information one for the kinds of the three nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import vocabulary as V
from chronoweave.operators import documents as D
from chronoweave.operators import motifs as MO
from chronoweave.operators.allen import oriented_labels

SMOOTHING = 10.0
LEAST_PRIOR = 1e-4
#: Share of a label that its kind does not have at all.
NO_PRIOR = 1e-6


def closed_grid(spark, **columns: list[str]) -> DataFrame:
    """All combinations of fixed values, in one partition."""
    out = spark.range(0, 1, 1, 1)
    for name, values in columns.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out.drop("id")


def label_prior(edges: DataFrame) -> DataFrame:
    """``(kind, rel, q)`` of the kinds that there are, with one added to each of the six labels."""
    counts = edges.select(MO.kind_of(edges).alias("kind"), "rel").groupBy("kind", "rel").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("kind").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("rel", "c"))).alias("by"))
    rows = totals.select("kind", "n", "by", F.explode(F.array(*map(F.lit, V.RELATIONS))).alias("rel"))
    return rows.select("kind", "rel", ((F.coalesce(F.try_element_at("by", F.col("rel")), F.lit(0)) + 1) / (F.col("n") + float(len(V.RELATIONS)))).alias("q"))


def base_label(oriented: Column) -> Column:
    return F.when(oriented.startswith("i"), F.substring(oriented, 2, 100)).otherwise(oriented)


def triangle_information(tri: DataFrame, prior: DataFrame, beta: float = SMOOTHING, raw: bool = False) -> DataFrame:
    """``(kinds, o_xy, o_yz, o_xz, n, pmi)`` over the whole grid of node kinds and oriented labels, seen or not.

    The share of an oriented label is that of the stored label on edges of the stored kind; a kind without a prior has that of
    event pairs.  Frequencies are shares of the triangles of their node kinds.  ``raw`` leaves the labels' own shares in: the
    logarithm of the smoothed frequency alone.  ``tri`` is triangles or their ``MO.configuration_counts``.
    """
    spark = tri.sparkSession
    q = {(r["kind"], r["rel"]): math.log(r["q"]) for r in prior.collect()}  # six rows a kind
    letters = sorted({x for kind, _ in q for x in kind}) or ["E"]
    kinds = {f"{x}{y}" for x in letters for y in letters}
    known = {k for k, _ in q}
    shares = [(k, o, q.get((k[::-1] if o[0] == "i" else k, o.removeprefix("i")) if (k[::-1] if o[0] == "i" else k) in known else ("EE", o.removeprefix("i")), math.log(NO_PRIOR))) for k in sorted(kinds) for o in oriented_labels()]
    share = spark.createDataFrame(shares, "k string, o string, l double").coalesce(1)
    names = oriented_labels()
    grid = closed_grid(spark, kinds=[f"{x}{y}{z}" for x in letters for y in letters for z in letters], o_xy=names, o_yz=names, o_xz=names)
    for name, k in (("o_xy", F.substring("kinds", 1, 2)), ("o_yz", F.substring("kinds", 2, 2)), ("o_xz", F.concat(F.substring("kinds", 1, 1), F.substring("kinds", 3, 1)))):
        grid = grid.withColumn("_k", k).join(F.broadcast(share.select(F.col("k").alias("_k"), F.col("o").alias(name), F.col("l").alias(f"l{name}"))), ["_k", name]).drop("_k")
    seen = tri if "n" in tri.columns else MO.configurations(tri)
    totals = seen.groupBy("kinds").agg(F.sum("n").alias("total"))
    log_q = F.col("lo_xy") + F.col("lo_yz") + F.col("lo_xz")
    rows = grid.join(F.broadcast(seen), MO.CONFIGURATION, "left").join(F.broadcast(totals), "kinds", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    value = F.log((F.col("n") + beta * F.exp(log_q)) / (F.col("total") + beta))
    return rows.select(*MO.CONFIGURATION, "n", (value if raw else value - log_q).alias("pmi"))


def channel_injected(prior: DataFrame, rate: float) -> DataFrame:
    """``(kind, obs, rel, log_p)`` of known noise: a label is kept with 1 - rate, else replaced by the other labels' shares."""
    p, l = prior.select("kind", F.col("rel").alias("obs"), F.col("q").alias("qp")), prior.select("kind", "rel", F.col("q").alias("ql"))
    other = F.log(F.greatest(F.lit(1e-9), rate * F.col("qp") / (1 - F.col("ql"))))
    return p.join(F.broadcast(l), "kind").select("kind", "obs", "rel", F.when(F.col("obs") == F.col("rel"), math.log(1 - rate)).otherwise(other).alias("log_p"))


def channel_none(prior: DataFrame) -> DataFrame:
    """``(kind, obs, rel, log_p)`` that says nothing, for energies without a channel."""
    return channel_injected(prior, 0.5).withColumn("log_p", F.lit(0.0))


def channel_confusion(labelled: DataFrame) -> DataFrame:
    """``(kind, obs, rel, log_p)`` from pairs of observed and true labels ``(obs, rel)``, half a count added to each cell."""
    cells = labelled.select(MO.kind_of(labelled).alias("kind"), "obs", "rel").groupBy("kind", "obs", "rel").agg(F.count(F.lit(1)).alias("c"))
    per = cells.groupBy("kind", "rel").agg(F.sum("c").alias("n"))
    labels = F.array(*map(F.lit, V.RELATIONS))
    grid = cells.select("kind").distinct().select("kind", F.explode(labels).alias("obs")).select("kind", "obs", F.explode(labels).alias("rel"))
    grid = grid.join(F.broadcast(cells), ["kind", "obs", "rel"], "left").join(F.broadcast(per), ["kind", "rel"], "left")
    return grid.select("kind", "obs", "rel", F.log((F.coalesce("c", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 3.0)).alias("log_p"))


def channel_exact(rate_rows: DataFrame, noisy: Column) -> DataFrame:
    """A channel that trusts labels where ``noisy`` is false: 0 for the observed one, log 1e-9 for the others."""
    return rate_rows.withColumn("log_p", F.when(noisy, F.col("log_p")).when(F.col("obs") == F.col("rel"), 0.0).otherwise(math.log(1e-9)))


def _options(prior: DataFrame, channel: DataFrame) -> DataFrame:
    """``(kind, obs, options)``: the labels of a kind with q and log_p, by name; a few rows a kind."""
    label = prior.select("kind", F.col("rel").alias("label"), "q").join(F.broadcast(channel.select("kind", "obs", F.col("rel").alias("label"), "log_p")), ["kind", "label"])
    return label.groupBy("kind", "obs").agg(F.array_sort(F.collect_list(F.struct("label", "q", "log_p"))).alias("options"))


def edge_energies(edges: DataFrame, prior: DataFrame, channel: DataFrame, information: DataFrame, *more: str, weight: float = 0.5, damping: float = 0.0, mean: bool = True) -> DataFrame:
    """``(doc, s, t, kind, obs, more..., triangles, options)``: each edge once, ``options`` is ``(label, energy, q)`` of its kind's labels.

    ``edges`` is ``(doc, s, t, rel)`` with the observed label as rel; the other edges stay as observed.  Triangles are summed
    where their document is.  The information table is a closed grid.
    """
    letters, table = information_array(information)
    codes = dict(_CODES)

    def kernel(g: D.Graph) -> Iterator[pa.RecordBatch]:
        sums, many = np.zeros((len(V.RELATIONS), len(g.rows))), np.zeros(len(g.rows), np.int64)
        letter = np.array([letters.get(x, -1) for x in g.letters])
        code = np.array([codes.get(x, -1) for x in g.names])
        for xy, yz, xz in g.triangles():
            x, y, z = letter[g.k_lo[xy]], letter[g.k_hi[xy]], letter[g.k_hi[yz]]
            known = (x >= 0) & (y >= 0) & (z >= 0)
            three = (x * len(letters) + y) * len(letters) + z
            for side, (own, one, two) in enumerate(((xy, yz, xz), (yz, xy, xz), (xz, xy, yz))):
                p, q = code[g.o[one]], code[g.o[two]]
                use = known & (p >= 0) & (q >= 0)
                at = own[use]
                told = table[three[use], side, g.back[at].astype(np.int64), p[use], q[use]]
                for i in range(len(V.RELATIONS)):
                    sums[i] -= np.bincount(at, told[:, i], len(g.rows))
                many += np.bincount(at, minlength=len(g.rows))
        yield pa.RecordBatch.from_arrays([*(g.rows[c].combine_chunks() for c in names), *map(pa.array, sums), pa.array(many)], names=[*names, *(f"_e{i}" for i in range(len(sums))), "triangles"])

    names = ["doc", "s", "t", "kind", "rel", *more]
    types = dict(edges.dtypes) | {"kind": "string"}
    found = D.run(edges, kernel, ", ".join([*(f"{c} {types[c]}" for c in names), *(f"_e{i} double" for i in range(len(V.RELATIONS))), "triangles long"]), *more)
    rows = found.withColumnRenamed("rel", "obs").join(F.broadcast(_options(prior, channel)), ["kind", "obs"])
    motif = F.map_from_arrays(F.array(*map(F.lit, V.RELATIONS)), F.array(*[F.col(f"_e{i}") / (F.col("triangles") if mean else 1) for i in range(len(V.RELATIONS))]))
    energy = lambda o, m: -(1 - damping) * F.log(o["q"]) - o["log_p"] + weight * F.coalesce(m, F.lit(0.0))
    options = F.transform("options", lambda o: F.struct(o["label"].alias("label"), energy(o, F.try_element_at("_motif", o["label"])).alias("energy"), o["q"].alias("q")))
    return rows.withColumn("_motif", F.when(F.col("triangles") > 0, motif)).select("doc", "s", "t", "kind", "obs", *more, "triangles", options.alias("options"))


def local_energy(edges: DataFrame, prior: DataFrame, channel: DataFrame, information: DataFrame, weight: float = 0.5, damping: float = 0.0, mean: bool = True) -> DataFrame:
    """``(doc, s, t, kind, obs, label, energy, triangles)`` of each label on each edge, the other edges as observed."""
    rows = edge_energies(edges, prior, channel, information, weight=weight, damping=damping, mean=mean)
    return rows.withColumn("o", F.explode("options")).select("doc", "s", "t", "kind", "obs", "o.label", "o.energy", "triangles", "o.q")


def information_array(information: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Letters of node kinds in order, and the information as an array by kinds, side, backwards, two codes and the side's label."""
    rows = information.collect()  # a closed grid of a few thousand rows
    letters = {x: i for i, x in enumerate(sorted({x for r in rows for x in r["kinds"]}))}
    n, m = len(letters), len(_CODES)
    grid = np.zeros((n, n, n, m, m, m))
    for r in rows:
        grid[(*[letters[x] for x in r["kinds"]], _CODES[r["o_xy"]], _CODES[r["o_yz"]], _CODES[r["o_xz"]])] = r["pmi"]
    # for each side its own label last, the other two in the order xy, yz, xz
    by_side = np.stack([np.moveaxis(grid, 3, 5), np.moveaxis(grid, 4, 5), grid], axis=3)
    by_way = np.stack([by_side[..., _READ[:, 0]], by_side[..., _READ[:, 1]]], axis=4)
    return letters, by_way.reshape(n**3, 3, 2, m, m, len(V.RELATIONS))


def best_option() -> Column:
    """An edge's label of least energy among its ``options``, the observed one unless another is lower by 1e-9.

    Labels that are rarer than 1e-4 are no choice.  Energies are compared to nine decimals, ties go to the label first by name.
    """
    now = F.array_min(F.transform(F.filter("options", lambda o: o["label"] == F.col("obs")), lambda o: F.round(o["energy"], 9)))
    choice = F.filter("options", lambda o: (o["label"] != F.col("obs")) & (o["q"] >= LEAST_PRIOR))
    other = F.array_min(F.transform(choice, lambda o: F.struct(F.round(o["energy"], 9).alias("e"), o["label"].alias("label"))))
    return F.when(other["e"] < now - 1e-9, other["label"]).otherwise(F.col("obs"))


def best_labels(energies: DataFrame) -> DataFrame:
    """``(doc, s, t, kind, obs, best)`` of ``local_energy``'s rows, by ``best_option``."""
    rows = energies.groupBy("doc", "s", "t", "kind", "obs").agg(F.collect_list(F.struct("label", "energy", "q")).alias("options"))
    return rows.select("doc", "s", "t", "kind", "obs", best_option().alias("best"))


def prior_channel_map(edges: DataFrame, prior: DataFrame, channel: DataFrame, *more: str) -> DataFrame:
    """``(doc, s, t, kind, obs, more..., best)`` without triangles."""
    rows = edges.select("doc", "s", "t", MO.kind_of(edges).alias("kind"), F.col("rel").alias("obs"), *more).join(F.broadcast(_options(prior, channel)), ["kind", "obs"])
    options = F.transform("options", lambda o: F.struct(o["label"].alias("label"), (-F.log(o["q"]) - o["log_p"]).alias("energy"), o["q"].alias("q")))
    return rows.withColumn("options", options).select("doc", "s", "t", "kind", "obs", *more, best_option().alias("best"))


# ------------------------------------------------------------------- repair

_CODES = {o: i for i, o in enumerate(oriented_labels())}
#: Code of a label read forwards and backwards.
_READ = np.array([[_CODES[r], _CODES[r if r in V.SYMMETRIC else f"i{r}"]] for r in V.RELATIONS])
#: Edges of whole documents that are repaired at a time, about.
BATCH_EDGES = 100_000


@dataclass
class Tables:
    """The closed tables of a repair as arrays: by kind and observed label, and by a triangle's kinds and two of its labels."""

    kinds: dict[str, int]
    letters: dict[str, int]
    own: np.ndarray  # kind, observed, label: energy of prior and channel; infinite where the label is no choice
    kept: np.ndarray  # kind, observed, label: the same without that bar, for the label that an edge has
    information: np.ndarray  # kinds (three letters), side, backwards, code, code, label

    @classmethod
    def of(cls, prior: DataFrame, channel: DataFrame, information: DataFrame, damping: float) -> Tables:
        q = {(r["kind"], r["rel"]): r["q"] for r in prior.collect()}  # closed tables, all three
        c = {(r["kind"], r["obs"], r["rel"]): r["log_p"] for r in channel.collect()}
        kinds = {k: i for i, k in enumerate(sorted({k for k, _ in q}, key=lambda k: (k != "EE", k)))}
        kept = np.array([[[-(1 - damping) * math.log(q[k, r]) - c.get((k, o, r), 0.0) for r in V.RELATIONS] for o in V.RELATIONS] for k in kinds])
        rare = np.array([[q[k, r] < LEAST_PRIOR for r in V.RELATIONS] for k in kinds])
        letters, array = information_array(information)
        missing = [x for x in sorted({x for k in kinds for x in k}) if x not in letters]
        if missing:  # kinds that no triangle information speaks of
            n, more = len(letters), len(letters) + len(missing)
            wide = np.zeros((more, more, more, *array.shape[1:]))
            wide[:n, :n, :n] = array.reshape(n, n, n, *array.shape[1:])
            letters, array = letters | {x: n + i for i, x in enumerate(missing)}, wide.reshape(more**3, *array.shape[1:])
        return cls(kinds, letters, np.where(rare[:, None, :], np.inf, kept), kept, array)


def _triangles_of(lo: np.ndarray, hi: np.ndarray, nodes: int) -> np.ndarray:
    """Rows ``(xy, yz, xz)`` of edge numbers: all triangles among edges from ``lo`` to ``hi``; of repeated pairs the last one counts."""
    key = lo * nodes + hi
    order = np.argsort(key, kind="stable")
    order = order[lo[order] < hi[order]]
    last = order[np.append(key[order][1:] != key[order][:-1], True)] if len(order) else order
    keys, starts = key[last], lo[last]
    ends = np.searchsorted(starts, starts, side="right")
    found = []
    for at in range(0, len(last), 20_000):  # wedges of some edges at a time
        first = np.arange(at, min(at + 20_000, len(last)))
        n = ends[first] - first - 1
        xy = np.repeat(first, n)
        xz = xy + 1 + np.arange(len(xy)) - np.repeat(np.cumsum(n) - n, n)
        wanted = hi[last][xy] * nodes + hi[last][xz]
        yz = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        real = keys[yz] == wanted
        found.append(np.stack([last[xy[real]], last[yz[real]], last[xz[real]]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


class Icm:
    """Iterated conditional modes in place, edges in ascending order, on many documents side by side.

    Documents do not touch each other, so the edges at one place of each document's order are judged together, all six labels
    of each at once.  A sweep visits the edges of triangles whose information is below zero, later ones the edges that share a
    triangle with an edge changed in the sweep before.
    """

    def __init__(self, tables: Tables, weight: float, mean: bool, sweeps: int):
        self.tables, self.weight, self.mean, self.sweeps = tables, weight, mean, sweeps

    def triangles_of(self, doc: np.ndarray, s: np.ndarray, t: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where each edge's triangles are, by edge: ``own, one, two, side, three, begin, back``.  No label enters."""
        tables, n = self.tables, len(doc)
        nodes = int(max(s.max(), t.max())) + 1 if n else 1
        # nodes of different documents are different nodes
        a, b = np.minimum(s, t), np.maximum(s, t)
        _, numbered = np.unique(np.concatenate([doc * nodes + a, doc * nodes + b]), return_inverse=True)
        lo, hi = numbered[:n], numbered[n:]
        tri = _triangles_of(lo, hi, 2 * n + 1)
        back = (s > t).astype(np.int64)
        letter = np.array([[tables.letters[x] for x in k] for k in tables.kinds])[kind]  # of start and end
        k_lo, k_hi = letter[np.arange(n), back], letter[np.arange(n), 1 - back]
        size = len(tables.letters)
        three = (k_lo[tri[:, 0]] * size + k_hi[tri[:, 0]]) * size + k_hi[tri[:, 1]]
        # each triangle once for each of its edges: that edge, the other two, and where its table row starts
        own = np.concatenate([tri[:, 0], tri[:, 1], tri[:, 2]])
        one = np.concatenate([tri[:, 1], tri[:, 0], tri[:, 0]])
        two = np.concatenate([tri[:, 2], tri[:, 2], tri[:, 1]])
        side = np.repeat(np.arange(3), len(tri))
        by = np.argsort(own, kind="stable")
        own, one, two, side, three = own[by], one[by], two[by], side[by], np.tile(three, 3)[by]
        return own, one, two, side, three, np.searchsorted(own, np.arange(n + 1)), back

    def run(self, doc: np.ndarray, s: np.ndarray, t: np.ndarray, kind: np.ndarray, observed: np.ndarray, triangles: tuple[np.ndarray, ...] | None = None) -> list[np.ndarray]:
        """Labels (numbers) after each sweep.  Rows are sorted by doc, s, t; ``doc`` and nodes are whole numbers in order.

        ``triangles`` are those of the same edges, where they are known; tables of the same kinds share them.
        """
        tables, n = self.tables, len(doc)
        own, one, two, side, three, begin, back = triangles or self.triangles_of(doc, s, t, kind)
        degree = np.diff(begin)
        label = observed.copy()
        sums = tables.information

        def rows_of(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Incidences of some edges, and where each edge's begin among them."""
            many = degree[edges]
            start = np.cumsum(many) - many
            return np.repeat(begin[edges], many) + np.arange(int(many.sum())) - np.repeat(start, many), start

        def told(at: np.ndarray) -> np.ndarray:
            return sums[three[at], side[at], back[own[at]], _READ[label[one[at]], back[one[at]]], _READ[label[two[at]], back[two[at]]]]

        place = np.arange(n) - np.searchsorted(doc, doc)
        by_place = np.argsort(place, kind="stable")
        steps = np.split(by_place, np.flatnonzero(np.diff(place[by_place])) + 1) if n else []
        bad = sums[three, side, back[own], _READ[label[one], back[one]], _READ[label[two], back[two]], label[own]] < 0
        due = np.zeros(n, bool)
        due[own[bad]] = True
        states = []
        for _ in range(self.sweeps):
            if not due.any():
                break
            following = np.zeros(n, bool)
            for step in steps:
                now = step[due[step]]
                if not len(now):
                    continue
                energy = tables.own[kind[now], observed[now]].copy()
                energy[np.arange(len(now)), label[now]] = tables.kept[kind[now], observed[now], label[now]]
                touched = now[degree[now] > 0]
                if len(touched):
                    at, start = rows_of(touched)
                    motif = -np.add.reduceat(told(at), start, axis=0)
                    energy[degree[now] > 0] += self.weight * (motif / degree[touched][:, None] if self.mean else motif)
                energy = np.round(energy, 9)
                best = energy.argmin(axis=1)
                change = energy[np.arange(len(now)), best] < energy[np.arange(len(now)), label[now]]
                moved = now[change]
                label[moved] = best[change]
                if len(moved):
                    at, _ = rows_of(moved)
                    following[one[at]] = True
                    following[two[at]] = True
            states.append(label.copy())
            due = following
        return states or [label]


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in parts of whole documents."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < BATCH_EDGES:
            continue
        rows = pd.concat(held, ignore_index=True)
        open_ = (rows["doc"] == rows["doc"].iloc[-1]).to_numpy()
        if not open_.all():
            yield rows[~open_]
        held, n = [rows[open_]], int(open_.sum()) if not open_.all() else 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _coded(rows: pd.DataFrame, tables: Tables) -> tuple[np.ndarray, ...]:
    """The columns that ``Icm.run`` takes; a kind that the tables lack counts as the first, which is EE if there is one."""
    doc = np.cumsum(np.append(False, rows["doc"].to_numpy()[1:] != rows["doc"].to_numpy()[:-1]))
    node, _ = pd.factorize(pd.concat([rows["s"], rows["t"]], ignore_index=True), sort=True)
    labels = {r: i for i, r in enumerate(V.RELATIONS)}
    return doc, node[: len(rows)], node[len(rows) :], rows["kind"].map(tables.kinds).fillna(0).to_numpy(np.int64), rows["rel"].map(labels).to_numpy(np.int64)


def _by_document(edges: DataFrame, *more: str) -> DataFrame:
    """Edges with one of the six labels, documents whole and in order."""
    rows = edges.where(F.col("rel").isin(list(V.RELATIONS)) & F.col("doc").isNotNull() & F.col("s").isNotNull() & F.col("t").isNotNull())
    rows = rows.select("doc", "s", "t", MO.kind_of(edges).alias("kind"), "rel", *more)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(n, "doc").sortWithinPartitions("doc", "s", "t")


def icm_repair(edges: DataFrame, prior: DataFrame, channel: DataFrame, information: DataFrame, weight: float = 0.5, damping: float = 0.0, mean: bool = True, sweeps: int = 4, trace: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, s, t, kind, obs, best, sweep, keep...)``: labels of each document after repair; with ``trace`` after each sweep.

    A label is changed for the one of least energy, energies compared to nine decimals, ties to the label first in the
    vocabulary; labels rarer than 1e-4 are no choice.  A document is repaired in one task; rows without a document, a node or a
    known label are left out.
    """
    tables = Tables.of(prior, channel, information, damping)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        icm, names = Icm(tables, weight, mean, sweeps), np.array(V.RELATIONS, object)
        for rows in _documents(batches):
            states = icm.run(*_coded(rows, tables))
            for sweep, state in list(enumerate(states, 1))[0 if trace else -1 :]:
                yield pd.DataFrame({"doc": rows["doc"], "s": rows["s"], "t": rows["t"], "kind": rows["kind"], "obs": rows["rel"], "best": names[state], "sweep": sweep if trace else 1, **{c: rows[c] for c in keep}})

    types = dict(edges.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in ("doc", "s", "t")), "kind string, obs string, best string, sweep long", *(f"{c} {types[c]}" for c in keep)])
    return _by_document(edges, *keep).mapInPandas(run, schema)


def grid_search(edges: DataFrame, prior: DataFrame, channel: DataFrame, information: DataFrame, grid: list[tuple[float, float, bool]], sweeps: int = 4) -> DataFrame:
    """``(weight, damping, mean, fixed, broken)`` of each point of a grid on edges that also have ``gold``; one pass over the documents."""
    by_damping = {d: Tables.of(prior, channel, information, d) for d in sorted({d for _, d, _ in grid})}
    points = [(w, d, m, by_damping[d]) for w, d, m in grid]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(V.RELATIONS, object)
        for rows in _documents(batches):
            gold, obs, out = rows["gold"].to_numpy(), rows["rel"].to_numpy(), []
            coded = _coded(rows, points[0][3])  # kinds and triangles are the same at every point
            triangles = Icm(points[0][3], 0.0, True, 1).triangles_of(*coded[:4])
            for weight, damping, mean, tables in points:
                best = names[Icm(tables, weight, mean, sweeps).run(*coded, triangles)[-1]]
                out.append((weight, damping, mean, int(((best == gold) & (obs != gold)).sum()), int(((best != gold) & (obs == gold)).sum())))
            yield pd.DataFrame(out, columns=["weight", "damping", "mean", "fixed", "broken"])

    per = _by_document(edges, "gold").mapInPandas(run, "weight double, damping double, mean boolean, fixed long, broken long")
    return per.groupBy("weight", "damping", "mean").agg(F.sum("fixed").alias("fixed"), F.sum("broken").alias("broken"))


def best_point(found: DataFrame, least_net: int = 1) -> DataFrame:
    """The grid's point of the highest net (fixed less broken); on ties fewer broken edges, then the smaller weight and damping.

    No row where no point reaches ``least_net``: repair is better left out.
    """
    net = F.col("fixed") - F.col("broken")
    return found.select("*", net.alias("net")).where(F.col("net") >= least_net).orderBy(F.desc("net"), "broken", "weight", "damping", "mean").limit(1)
