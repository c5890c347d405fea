"""Maximum inner product search with score-aware anisotropic product quantisation (operator 5).

Vectors are coded by 16 centroids (four bits) in each small subspace.  Codebooks and codes minimise a loss that weighs the
residual along the vector more than the residual across it, since for a query that matters, one near the vector, only the
first changes the score.  Every row is coded, and every code is scanned: on vectors without clusters, such as the given ones,
coarse partitions must probe half of the table for a recall of 0.9 (README has the figures).  Queries meet candidates in blocks: a query's tables of inner products with the
centroids are summed over each block's codes, the best sums are scored again on the original vectors in double precision, and
the blocks' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import cut, partitions

#: Vectors that the codebooks are fitted on, about; the sample is a fixed function of the id.
SAMPLE_ROWS = 16_000
CENTROIDS = 16
#: Rows of a block of candidates and of a block of queries, about.
CANDIDATES_BLOCK, QUERIES_BLOCK = 32_768, 16_384
#: Candidate blocks at least, so that a small table still keeps all cores busy.
LEAST_BLOCKS = 12


@dataclass
class Codebook:
    """``centroids[m, c]`` is centroid c of subspace m; ``eta`` the weight of the parallel over the orthogonal residual."""

    centroids: np.ndarray
    eta: float

    @property
    def width(self) -> int:
        return self.centroids.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows x subspaces x width, padded with zeros."""
        m, w = self.centroids.shape[0], self.width
        padded = np.zeros((len(x), m * w))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, w)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that minimise the anisotropic loss, by coordinate descent from the nearest centroids."""
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        n, m, _ = parts.shape
        rows = np.arange(n)
        codes = np.empty((n, m), np.int64)
        across = np.empty((m, n, CENTROIDS), np.float32)
        along = np.empty((m, n, CENTROIDS), np.float32)
        for j in range(m):
            diff = parts[:, j, None, :] - self.centroids[j][None]
            across[j] = (diff**2).sum(axis=2)
            along[j] = (diff * unit[:, j, None, :]).sum(axis=2)
            codes[:, j] = across[j].argmin(axis=1)
        parallel = sum(along[j][rows, codes[:, j]] for j in range(m))
        for _ in range(sweeps):
            for j in range(m):
                rest = parallel - along[j][rows, codes[:, j]]
                codes[:, j] = (across[j] + (self.eta - 1) * (rest[:, None] + along[j]) ** 2).argmin(axis=1)
                parallel = rest + along[j][rows, codes[:, j]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The centroids that minimise the loss for fixed codes: normal equations over all centroids at once."""
        parts = self.split(x)
        norm = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
        unit = parts / norm[:, None, None]
        m, k, w = self.centroids.shape
        size, n = m * k * w, len(x)
        left, right = np.zeros((size, size)), np.zeros(size)
        for start in range(0, n, 4096):
            c, p, u = codes[start : start + 4096], parts[start : start + 4096], unit[start : start + 4096]
            design = np.zeros((len(c), m, k, w))
            which = np.arange(len(c))[:, None], np.arange(m)[None, :], c
            design[which] = u
            design = design.reshape(len(c), size)
            left += (self.eta - 1) * design.T @ design
            right += (self.eta - 1) * design.T @ norm[start : start + 4096]
            sums, counts = np.zeros((m, k, w)), np.zeros((m, k))
            np.add.at(sums, which[1:], p)
            np.add.at(counts, which[1:], 1)
            right += sums.ravel()
            left[np.arange(size), np.arange(size)] += np.repeat(counts.ravel(), w)
        ridge = 1e-3 * n / k
        left[np.arange(size), np.arange(size)] += ridge
        self.centroids = np.linalg.solve(left, right + ridge * self.centroids.ravel()).reshape(m, k, w)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with the centroids: queries x subspaces x 16."""
        return np.einsum("qmw,mkw->qmk", self.split(q), self.centroids).astype(np.float32)


def fit_codebook(x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 4, seed: int = 3) -> Codebook:
    """Centroids from k-means in each subspace, then rounds of anisotropic coding and refitting.

    ``threshold`` is the cosine from which a query counts; it sets eta to (d - 1) t^2 / (1 - t^2), at least 1.
    """
    d = x.shape[1]
    m = -(-d // width)
    book = Codebook(np.zeros((m, CENTROIDS, width)), max(1.0, (d - 1) * threshold**2 / (1 - threshold**2)))
    parts = book.split(x)
    start = np.random.default_rng(seed).choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)
    for j in range(m):
        p = parts[:, j]
        c = p[start] + 1e-6 * np.arange(CENTROIDS)[:, None]
        for _ in range(10):
            near = ((p[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(near, minlength=CENTROIDS)
            for w in range(width):
                s = np.bincount(near, p[:, w], CENTROIDS)
                c[n > 0, w] = s[n > 0] / n[n > 0]
        book.centroids[j] = c
    for _ in range(rounds):
        book.refit(x, book.encode(x))
    return book


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
    return (codes[:, 0::2] * CENTROIDS + codes[:, 1::2]).astype(np.uint8)


def byte_tables(tables: np.ndarray) -> np.ndarray:
    """Tables of two neighbouring subspaces as one table of 256 sums."""
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], axis=1)
    return (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(tables), -1, CENTROIDS**2)


def best_of(approximate: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n largest, ties to the earlier position."""
    if len(approximate) <= n:
        return np.arange(len(approximate))
    least = np.partition(approximate, len(approximate) - n)[len(approximate) - n]
    above = np.flatnonzero(approximate > least)
    return np.concatenate([above, np.flatnonzero(approximate == least)[: n - len(above)]])


def usable(v: str | Column) -> Column:
    """Not null, not empty, no component null or not finite, not all zero."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, rerank: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row its ``k`` candidates of largest inner product found.

    Candidates are all usable rows but those with the query's own id; ``rerank`` of each block of candidates are scored
    exactly.  Vectors that are not usable, and those whose length is not the table's most frequent one, take no part.  Equal
    scores go to the smaller id.  Rows without an id take no part; an empty table gives no rows.  Rows that repeat an id are
    one row, of the smallest of their vectors, and a query if one of them is.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("q")).where("id is not null").where(usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("v") == (lengths["d"] if lengths else 0)).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = cut(rows)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("q")).first()
    if not sizes["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, queries = sizes["n"], sizes["q"]
    share = min(1.0, SAMPLE_ROWS / total)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < max(1, int(share * (1 << 30)))).select("id", "v").toPandas().sort_values("id", kind="stable")
    if not len(sample):
        sample = rows.select("id", "v").limit(1).toPandas()
    book = fit_codebook(np.array(sample["v"].tolist(), np.float64))
    shared = spark.sparkContext.broadcast(book)
    candidate_blocks = max(LEAST_BLOCKS, -(-total // CANDIDATES_BLOCK))
    query_blocks = -(-queries // QUERIES_BLOCK)
    block_of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = pack(shared.value.encode(np.array(batch["v"].tolist(), np.float64)))
                yield batch.assign(codes=[c.tobytes() for c in codes])

    indexed = rows.select("id", "v").mapInPandas(code, "id long, v array<double>, codes binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = vectors.schema[vector_column].dataType  # the original width of the components, to move no more than that
    candidates = indexed.select(block_of(candidate_blocks).alias("cb"), every(query_blocks).alias("qb"), F.lit(0).alias("kind"), "id", F.col("v").cast(kept).alias("v"), "codes")
    asked = rows.where("q").select(every(candidate_blocks).alias("cb"), block_of(query_blocks).alias("qb"), F.lit(1).alias("kind"), "id", F.col("v").cast(kept).alias("v"), F.lit(None).cast("binary").alias("codes"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows: each cell's candidates by id, then its queries."""
        book = shared.value
        cell, ids, codes, x = None, [], [], []
        for batch in batches:
            found = []
            for (cb, qb, kind), part in batch.groupby(["cb", "qb", "kind"], sort=True):
                if cell != (cb, qb):
                    cell, ids, codes, x = (cb, qb), [], [], []
                v = np.array(part["v"].tolist(), np.float64)
                if kind == 0:
                    ids.append(part["id"].to_numpy())
                    codes.append(np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), -1))
                    x.append(v)
                    continue
                if not ids:
                    continue
                if not codes[0].flags["F_CONTIGUOUS"] or len(ids) > 1:  # the first queries of a cell: candidates are complete
                    ids, codes, x = [np.concatenate(ids)], [np.asfortranarray(np.concatenate(codes))], [np.concatenate(x)]
                own, columns, all_x = ids[0], codes[0], x[0]
                for start in range(0, len(v), 256):  # tables of a few queries at a time
                    tables_of = byte_tables(book.tables(v[start : start + 256]))
                    for query_id, q, tables in zip(part["id"][start : start + 256], v[start : start + 256], tables_of):
                        sums = tables[0][columns[:, 0]]
                        for j in range(1, columns.shape[1]):
                            sums += tables[j][columns[:, j]]
                        at = best_of(sums, rerank + 1)
                        at = at[own[at] != query_id]
                        score = (all_x[at] * q).sum(axis=1)
                        best = np.lexsort((own[at], -score))[:k]
                        found.append(pd.DataFrame({"query_id": query_id, "vec_id": own[at][best], "score": score[best]}))
            if found:
                yield pd.concat(found, ignore_index=True)

    cells = candidates.unionByName(asked).repartition(max(partitions(spark), candidate_blocks * query_blocks), "cb", "qb").sortWithinPartitions("cb", "qb", "kind", "id")
    lists = cells.mapInPandas(scan, "query_id long, vec_id long, score double")
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
