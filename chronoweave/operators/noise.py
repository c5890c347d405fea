"""Noise for tests of repair, and resampling of documents."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.functions import vocabulary as V
from chronoweave.operators.motifs import kind_of


def replacements(prior: DataFrame) -> DataFrame:
    """``(kind, rel, upto, others)``: the five other labels of each label and kind, and how far their shares reach when summed."""
    q: dict[str, dict[str, float]] = {}
    for r in prior.collect():  # six rows a kind
        q.setdefault(r["kind"], {})[r["rel"]] = r["q"]
    rows = []
    for kind, share in q.items():
        for gold in V.RELATIONS:
            others = [r for r in V.RELATIONS if r != gold]
            total, upto = sum(share[r] for r in others), [0.0]
            for r in others[:-1]:
                upto.append(upto[-1] + share[r] / total)
            rows.append((kind, gold, upto, others))
    return prior.sparkSession.createDataFrame(rows, "kind string, rel string, upto array<double>, others array<string>").coalesce(1)


def inject(edges: DataFrame, prior: DataFrame, rate: float, seed: str = "37", where: Column | None = None) -> DataFrame:
    """``edges`` with ``obs``: at ``rate`` a label is replaced by another one, drawn by the shares of labels on edges of its kind.

    Both draws are hashes of the edge, so they are the same wherever and however often they run.  ``where`` limits the noise.
    """
    draw = lambda salt: S.hash_uniform(F.col("doc"), F.col("s"), F.col("t"), seed=salt)
    hit = draw(seed) < rate
    if where is not None:
        hit = hit & where
    # the draw is a column of its own, so that it is hashed once and not for each label that it is compared with
    rows = edges.withColumns({"_hit": hit, "_pick": draw(f"{seed}b"), "_kind": kind_of(edges)})
    table = replacements(prior).select(F.col("kind").alias("_kind"), "rel", *[F.get("upto", F.lit(i)).alias(f"_u{i}") for i in range(1, 5)], F.col("others").alias("_others"))
    rows = rows.join(F.broadcast(table), ["_kind", "rel"], "left")
    place = sum(F.when(F.col("_pick") >= F.col(f"_u{i}"), 1).otherwise(0) for i in range(1, 5))
    return rows.select(*edges.columns, F.when(F.col("_hit"), F.coalesce(F.get("_others", place), "rel")).otherwise(F.col("rel")).alias("obs"))


def document_confusions(rows: DataFrame) -> DataFrame:
    """``(doc, gold, pred, n)``: what a bootstrap over documents needs."""
    return rows.groupBy("doc", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def _macro(matrix: np.ndarray) -> np.ndarray:
    hit = np.einsum("...ii->...i", matrix)
    total = matrix.sum(axis=-1) + matrix.sum(axis=-2)
    return np.where(total > 0, 2 * hit / np.maximum(total, 1), 0.0).mean(axis=-1)


#: The chances that a Poisson number of mean one is at most 0, 1, 2 ... 8.
POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320]))


def poisson_one(keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Poisson numbers of mean one, a fixed function of a document's key and the resample's number."""
    x = keys + turn * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    return np.searchsorted(POISSON, x.astype(np.float64) / (1 << 53), side="right").astype(np.float64)


def paired_bootstrap(a: DataFrame, b: DataFrame, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """``(diff, lo, hi, p)``: macro F1 of a less b with a 95 % interval and a two-sided p-value, resampled by document.

    A resample weighs each document by a Poisson number made from its hash, so documents may be cut between batches: each task
    returns sums of weighted confusions, one matrix for each resample.
    """
    spark = a.sparkSession
    index = {r: i for i, r in enumerate(V.RELATIONS)}
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))

    size = len(index)

    def run(frames):
        import pandas as pd

        sums = np.zeros((resamples + 1, 2 * size * size))
        for frame in frames:
            frame = frame[frame["gold"].isin(index.keys()) & frame["pred"].isin(index.keys())]
            if not len(frame):
                continue
            docs, row = np.unique(frame["doc"].astype(str), return_inverse=True)
            cell = (frame["side"].to_numpy() * size + frame["gold"].map(index).to_numpy()) * size + frame["pred"].map(index).to_numpy()
            counts = np.zeros((len(docs), 2 * size * size))
            np.add.at(counts, (row, cell), frame["n"].to_numpy(np.float64))
            keys = np.array([int.from_bytes(hashlib.blake2b(f"{seed}|{d}".encode(), digest_size=8).digest(), "little") for d in docs], np.uint64)
            sums[0] += counts.sum(axis=0)
            for at in range(0, resamples, 256):
                drawn = poisson_one(keys[:, None], np.arange(at, min(at + 256, resamples), dtype=np.uint64)[None, :])
                sums[1 + at : 1 + at + drawn.shape[1]] += drawn.T @ counts
        sums = sums.reshape(-1, 2, size, size)
        where = np.argwhere(sums)
        yield pd.DataFrame({"resample": where[:, 0], "side": where[:, 1], "g": where[:, 2], "p": where[:, 3], "n": sums[tuple(where.T)]})

    # a document's numbers are drawn once where all of its cells come together
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cells = both.select("doc", "side", "gold", "pred", "n").repartition(parts, "doc").sortWithinPartitions("doc").mapInPandas(run, "resample long, side long, g long, p long, n double").groupBy("resample", "side", "g", "p").agg(F.sum("n").alias("n")).toPandas()
    m = np.zeros((resamples + 1, 2, len(index), len(index)))
    m[cells["resample"].astype(int), cells["side"].astype(int), cells["g"].astype(int), cells["p"].astype(int)] = cells["n"]
    f = _macro(m)
    diff = f[:, 0] - f[:, 1]
    lo, hi = np.quantile(diff[1:], [0.025, 0.975])
    p = min(1.0, 2 * min((diff[1:] <= 0).mean(), (diff[1:] >= 0).mean()))
    return spark.createDataFrame([(float(diff[0]), float(lo), float(hi), float(p))], "diff double, lo double, hi double, p double")


def seed_summary(runs: DataFrame) -> DataFrame:
    """``(metric, runs, mean, sd, half)``: mean over seeds and half the 95 % t interval of ``(metric, seed, value)``.

    Fixed values: the t quantiles of up to ten runs.
    """
    t = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262)
    rows = runs.groupBy("metric").agg(F.count(F.lit(1)).alias("runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    quantile = F.coalesce(F.get(F.array(*map(F.lit, t)), (F.col("runs") - 2).cast("int")), F.lit(1.96))
    return rows.withColumn("half", quantile * F.col("sd") / F.sqrt("runs"))
