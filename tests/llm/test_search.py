import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronoweave.llm import quantized_search as Q


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[ids[i]] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 17)).astype(np.float32).astype(np.float64)
    x[50:60] = x[40]  # ties
    ids = np.arange(600)
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in Q.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(ids, x, range(0, 600, 20), 20)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and q not in [r[1] for r in rows]
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.95


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [2.0, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, codes string, rank int")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in Q.search(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 6, 2.0)]
    assert Q.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_codes_follow_the_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    book = Q.fit_codebook(x)
    codes = book.encode(x)
    back = np.concatenate([book.centroids[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)
    unit = x / np.linalg.norm(x, axis=1)[:, None]

    def loss(y):
        r = x - y
        along = (r * unit).sum(axis=1)
        return ((r**2).sum(axis=1) + (book.eta - 1) * along**2).sum()

    nearest = np.concatenate([book.centroids[m][((book.split(x)[:, m, None] - book.centroids[m]) ** 2).sum(2).argmin(1)] for m in range(codes.shape[1])], axis=1)
    assert loss(back) <= loss(nearest) + 1e-9
    tables, q = book.tables(x[:3]), x[:3]
    sums = sum(Q.byte_tables(tables)[:, j, Q.pack(codes)[:, j]] for j in range(Q.pack(codes).shape[1]))
    assert np.allclose(sums, q @ back.T, atol=1e-4)


def test_recall_where_few_candidates_are_scored(spark):
    """24,000 vectors without clusters; 12 blocks of 33 reranked rows are 1.7 % of them, so the codes must do the work."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(24_000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0.5, 1.5, (24_000, 1))).astype(np.float32)
    table = pa.table({"vec_id": np.arange(24_000), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 32).cast(pa.list_(pa.float32()))})
    queries = list(range(0, 24_000, 240))
    got: dict = {}
    for r in Q.search(spark.createDataFrame(table), F.col("vec_id") % 240 == 0, rerank=32).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert Q.LEAST_BLOCKS * 33 < 0.02 * len(x) and len(x) <= Q.LEAST_BLOCKS * Q.CANDIDATES_BLOCK
    exact = x.astype(np.float64)
    hits = 0
    for q in queries:
        score = exact @ exact[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist()))
    assert hits / (20 * len(queries)) >= 0.9


def test_repeated_rows_are_one(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 1.0])]
    df = spark.createDataFrame(rows * 3 + [(1, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in Q.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
