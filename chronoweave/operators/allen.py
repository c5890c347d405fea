"""Allen's interval algebra: relations, composition, and whether three labels can hold together."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import vocabulary as V
from chronoweave.operators import documents as D


def basic_relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The one Allen relation of two intervals with positive length."""
    return (
        F.when(e1 < s2, "b").when(e2 < s1, "bi").when(e1 == s2, "m").when(e2 == s1, "mi")
        .when((s1 == s2) & (e1 == e2), "e").when(s1 == s2, F.when(e1 < e2, "s").otherwise("si")).when(e1 == e2, F.when(s1 > s2, "f").otherwise("fi"))
        .when((s1 < s2) & (e2 < e1), "di").when((s2 < s1) & (e1 < e2), "d").when(s1 < s2, "o").otherwise("oi")
    )


def compositions(spark: SparkSession, grid: int = 7) -> DataFrame:
    """``(r1, r2, r3)``: all that r1 and r2 in a row allow, found over all intervals of a small grid; its size is fixed."""
    points = spark.range(grid)
    spans = points.select(F.col("id").alias("s")).join(points.select(F.col("id").alias("e")), F.col("s") < F.col("e"))
    i, j, k = (spans.select(F.col("s").alias(f"s{n}"), F.col("e").alias(f"e{n}")) for n in "123")
    c = F.col
    rows = i.crossJoin(j).crossJoin(k)
    return rows.select(
        basic_relation(c("s1"), c("e1"), c("s2"), c("e2")).alias("r1"), basic_relation(c("s2"), c("e2"), c("s3"), c("e3")).alias("r2"), basic_relation(c("s1"), c("e1"), c("s3"), c("e3")).alias("r3")
    ).distinct()


def _basic(s1: int, e1: int, s2: int, e2: int) -> str:
    if e1 < s2:
        return "b"
    if e2 < s1:
        return "bi"
    if e1 == s2:
        return "m"
    if e2 == s1:
        return "mi"
    if s1 == s2:
        return "e" if e1 == e2 else "s" if e1 < e2 else "si"
    if e1 == e2:
        return "f" if s1 > s2 else "fi"
    if s1 < s2:
        return "di" if e2 < e1 else "o"
    return "d" if e1 < e2 else "oi"


@lru_cache(maxsize=1)
def composition_table() -> dict[tuple[str, str], frozenset[str]]:
    """The same table for the driver: 13 by 13 entries."""
    spans = [(s, e) for s in range(7) for e in range(s + 1, 7)]
    table: dict[tuple[str, str], set[str]] = {}
    for i in spans:
        for j in spans:
            for k in spans:
                table.setdefault((_basic(*i, *j), _basic(*j, *k)), set()).add(_basic(*i, *k))
    return {k: frozenset(v) for k, v in table.items()}


def allen_set(oriented: str) -> frozenset[str]:
    """What an oriented label allows."""
    if oriented in V.ALLEN_OF:
        return frozenset(V.ALLEN_OF[oriented])
    return frozenset(V.CONVERSE[r] for r in V.ALLEN_OF[oriented[1:]])


def oriented_labels() -> list[str]:
    return sorted([*V.RELATIONS, *(f"i{r}" for r in V.RELATIONS if r not in V.SYMMETRIC)])


def _compose(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    table = composition_table()
    return frozenset().union(*(table[x, y] for x in a for y in b)) if a and b else frozenset()


def _converse(a: frozenset[str]) -> frozenset[str]:
    return frozenset(V.CONVERSE[x] for x in a)


def inconsistent(xy: str, yz: str, xz: str) -> bool:
    """Whether path consistency empties one of three oriented labels: each is cut by the other two until nothing changes."""
    a, b, c = allen_set(xy), allen_set(yz), allen_set(xz)
    while True:
        new_c = c & _compose(a, b)
        new_a = a & _compose(new_c, _converse(b))
        new_b = b & _compose(_converse(new_a), new_c)
        if not (new_a and new_b and new_c):
            return True
        if (new_a, new_b, new_c) == (a, b, c):
            return False
        a, b, c = new_a, new_b, new_c


@lru_cache(maxsize=1)
def _contradictions() -> list[tuple[str, str, str]]:
    names = oriented_labels()
    return [(a, b, c) for a in names for b in names for c in names if inconsistent(a, b, c)]


def inconsistent_triples(spark: SparkSession) -> DataFrame:
    """``(o_xy, o_yz, o_xz)`` of the triples of oriented labels that cannot hold; at most 1,000 rows, so it may be broadcast."""
    return spark.createDataFrame(_contradictions(), "o_xy string, o_yz string, o_xz string").coalesce(1)


def edge_states(edges: DataFrame, *more: str) -> DataFrame:
    """``edges`` with ``bad``: 1 where an edge lies in a contradictory triangle, 0 where only in others, null where in none."""
    return D.edge_states(edges, _contradictions(), *more)


def conflicts(tri: DataFrame) -> DataFrame:
    """Triangles whose labels contradict each other."""
    return tri.join(F.broadcast(inconsistent_triples(tri.sparkSession)), ["o_xy", "o_yz", "o_xz"], "left_semi")


def endpoint_models(spark: SparkSession, points: int = 6, allow_points: bool = False) -> DataFrame:
    """Assignments of three intervals to ``points`` places: ``(s1, e1, s2, e2, s3, e3)``; the grid is fixed and small."""
    out = None
    for n in "123":
        span = spark.range(points).select(F.col("id").alias(f"s{n}")).crossJoin(spark.range(points).select(F.col("id").alias(f"e{n}")))
        span = span.where(F.col(f"s{n}") <= F.col(f"e{n}") if allow_points else F.col(f"s{n}") < F.col(f"e{n}"))
        out = span if out is None else out.crossJoin(span)
    return out


def reading(label: str, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """A label as a condition on endpoints."""
    return {
        "BEFORE": e1 < s2,
        "CONTAINS": (s1 < s2) & (e2 < e1),
        "SIMULTANEOUS": (s1 == s2) & (e1 == e2),
        "OVERLAP": (s1 < s2) & (s2 < e1) & (e1 < e2),
        "BEGINS-ON": s1 == s2,
        "ENDS-ON": (e1 == s2) | (e1 < s2),
    }[label]


def satisfiable_triples(spark: SparkSession, allow_points: bool = False) -> DataFrame:
    """``(xy, yz, xz)`` of labels that some endpoints satisfy together."""
    m = endpoint_models(spark, allow_points=allow_points)
    c = F.col
    held = lambda i, j: F.array_compact(F.array(*[F.when(reading(r, c(f"s{i}"), c(f"e{i}"), c(f"s{j}"), c(f"e{j}")), r) for r in V.RELATIONS]))
    rows = m.select(held(1, 2).alias("a"), held(2, 3).alias("b"), held(1, 3).alias("d")).distinct()
    return rows.select(F.explode("a").alias("xy"), "b", "d").select("xy", F.explode("b").alias("yz"), "d").select("xy", "yz", F.explode("d").alias("xz")).distinct()


def forced_labels(spark: SparkSession) -> DataFrame:
    """``(xy, yz, n, forced)``: how many labels two neighbours leave for the third side, and which one if it is one."""
    s = satisfiable_triples(spark).groupBy("xy", "yz").agg(F.count(F.lit(1)).alias("n"), F.min("xz").alias("only"))
    return s.select("xy", "yz", "n", F.when(F.col("n") == 1, F.col("only")).alias("forced"))
