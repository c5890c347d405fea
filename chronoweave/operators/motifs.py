"""Triangles and paths of a document's edges ``(doc, s, t, rel)``, and what they say of labels.

Edges are stored in one direction; an oriented label read from an edge's end starts with i.  ``kind`` names the kinds of an
edge's start and end, a letter each (E an event, T a time expression); edges without that column are event pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.operators import documents as D

#: The columns that say which labels on which kinds of nodes a triangle has.
CONFIGURATION = ["kinds", "o_xy", "o_yz", "o_xz"]


def kind_of(edges: DataFrame) -> Column:
    return F.col("kind") if "kind" in edges.columns else F.lit("EE")


def canonical(edges: DataFrame) -> DataFrame:
    """``(doc, lo, hi, rev, rel, o, k)``: each edge from its smaller to its larger node, o its label and k its kind in that direction."""
    rev, kind = F.col("s") > F.col("t"), kind_of(edges)
    return edges.select("doc", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), rev.alias("rev"), "rel", S.oriented(F.col("rel"), rev).alias("o"), F.when(rev, F.reverse(kind)).otherwise(kind).alias("k"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(doc, x, y, z, kinds, o_xy, o_yz, o_xz, rev_xy, rev_yz, rev_xz)`` with x < y < z and all three edges.

    Joins are on document and node, so every step is dealt out by both.
    """
    e = canonical(edges)
    side = lambda a, b, *more: e.select("doc", F.col("lo").alias(a), F.col("hi").alias(b), F.col("o").alias(f"o_{a}{b}"), F.col("rev").alias(f"rev_{a}{b}"), *more)
    wedge = side("x", "y", F.col("k").alias("k_xy")).join(side("y", "z", F.substring("k", 2, 1).alias("k_z")), ["doc", "y"])
    return wedge.join(side("x", "z"), ["doc", "x", "z"]).select("doc", "x", "y", "z", F.concat("k_xy", "k_z").alias("kinds"), "o_xy", "o_yz", "o_xz", "rev_xy", "rev_yz", "rev_xz")


def configurations(tri: DataFrame) -> DataFrame:
    """``(kinds, o_xy, o_yz, o_xz, n)``: node kinds and oriented labels of triangles and their frequency."""
    return tri.groupBy(*CONFIGURATION).agg(F.count(F.lit(1)).alias("n"))


def configuration_counts(edges: DataFrame, group: str | None = None) -> DataFrame:
    """The same of all triangles of ``edges``, which are counted where they are found; ``group`` is a whole number of each document."""
    return D.configuration_counts(edges, group)


def closure(edges: DataFrame) -> DataFrame:
    """``(doc, u, v, o, kv)``: each edge in both directions with the label read in each, and the kind of the node it leads to."""
    kind = kind_of(edges)
    forward = edges.select("doc", F.col("s").alias("u"), F.col("t").alias("v"), F.col("rel").alias("o"), F.substring(kind, 2, 1).alias("kv"))
    return forward.unionByName(edges.select("doc", F.col("t").alias("u"), F.col("s").alias("v"), S.read_backwards(F.col("rel")).alias("o"), F.substring(kind, 1, 1).alias("kv")))


def two_hop(edges: DataFrame, most: int = 4) -> DataFrame:
    """``(doc, s, t, family, m, o1, o2)``: the first ``most`` nodes m between an edge's ends in each family.

    A family is the edge's kind, the number of nodes of the motif and the kind of the node between.
    """
    return D.two_hop(edges, most)


def three_hop(edges: DataFrame, most: int = 4) -> DataFrame:
    """``(doc, s, t, family, m, y, o1, o2, o3)``: the first ``most`` paths s, m, y, t of four different nodes in each family."""
    return D.three_hop(edges, most)


def graph_atoms(hops: DataFrame) -> DataFrame:
    """``(doc, s, t, atom)``: the labels along the paths of each edge with their family, each once."""
    atom = F.concat(F.lit("GRAPH|"), F.col("family"), F.lit("|"), F.concat_ws(">", *[c for c in ("o1", "o2", "o3") if c in hops.columns]))
    return hops.select("doc", "s", "t", atom.alias("atom")).distinct()


def motif_atoms(edges: DataFrame, most: int = 4, *more: str) -> DataFrame:
    """``edges`` with ``atoms``, an array of the graph atoms of each edge's first two-hop paths."""
    return D.motif_atoms(edges, most, *more)


def path_atom_counts(edges: DataFrame) -> DataFrame:
    """``(atom, n)``: atoms of all paths of two and of three hops, none left out, and the edges that have each."""
    return D.path_atom_counts(edges)


def unseen(tri: DataFrame, known: DataFrame) -> DataFrame:
    """Triangles whose configuration the known ones lack."""
    return tri.join(known, CONFIGURATION, "left_anti")


def sides(tri: DataFrame) -> DataFrame:
    """``(doc, lo, hi, ...)``: each triangle once for each of its edges."""
    parts = [tri.select("*", F.col(a).alias("lo"), F.col(b).alias("hi"), F.lit(f"{a}{b}").alias("side")) for a, b in (("x", "y"), ("y", "z"), ("x", "z"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def violating_chains(edges: DataFrame, outer: str = "ENDS-ON", inner: str = "BEFORE") -> DataFrame:
    """``(doc, a, x, c)``: an outer edge a-c spanned by two inner ones over x, which cannot all hold."""
    pick = lambda rel, a, b: edges.where(F.col("rel") == rel).select("doc", F.col("s").alias(a), F.col("t").alias(b))
    return pick(outer, "a", "c").join(pick(inner, "a", "x"), ["doc", "a"]).join(pick(inner, "x", "c"), ["doc", "x", "c"]).select("doc", "a", "x", "c")
