"""Invariant checks; each returns the rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.functions import vocabulary as V
from chronoweave.operators import documents as D


def _violations(df: DataFrame, check: str, *columns: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col("doc").cast("string").alias("doc"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("what"))


def dangling(edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = ("s", "t", "rel")) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("doc", F.col("ev").alias("n")).distinct()
    missing = [edges.join(known.withColumnRenamed("n", end), ["doc", end], "left_anti").select("doc", *columns) for end in ("s", "t")]
    return _violations(missing[0].unionByName(missing[1]).distinct(), "dangling", *columns)


def input_shape(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Argument edges whose source is no event, or whose target is one: the guard against label leaks."""
    source = edges.join(events.select("doc", F.col("ev").alias("s")).distinct(), ["doc", "s"], "left_anti")
    target = edges.join(events.select("doc", F.col("ev").cast("string").alias("anchor")).distinct(), ["doc", "anchor"], "left_semi").select(*source.columns)
    return _violations(source.unionByName(target).distinct(), "input_shape", "s", "anchor", "role")


def schema_only(df: DataFrame, allowed: tuple[str, ...]) -> list[str]:
    """Columns that the layer may not carry."""
    return sorted(set(df.columns) - set(allowed))


def no_label_columns(df: DataFrame) -> list[str]:
    """Names under which a label could leak into features."""
    return sorted(set(df.columns) & {"rel", "gold", "allen", "n_temporal_edges", "temporal_degree", "hull"})


def symmetric_order(edges: DataFrame) -> DataFrame:
    return _violations(edges.where(S.is_symmetric(F.col("rel")) & (F.col("s") > F.col("t"))), "symmetric_order", "s", "t", "rel")


def two_labels(edges: DataFrame) -> DataFrame:
    """Ordered pairs with more than one label; a document's pairs are compared in its task."""
    return _violations(D.labels_of_pairs(edges).where("n > 1"), "two_labels", "s", "t", "n")


def opposite_labels(edges: DataFrame) -> DataFrame:
    """Pairs labelled in both directions; a document's pairs are compared in its task."""
    return _violations(D.with_opposite(edges).where("s < t and opposite"), "opposite_labels", "s", "t", "rel")


def self_loops(edges: DataFrame, kind: str = "rel") -> DataFrame:
    return _violations(edges.where("s = t"), "self_loop", "s", "t", kind)


def node_invariants(events: DataFrame, timexes: DataFrame) -> DataFrame:
    """Events without mentions or with more sentences than mentions; time expressions whose anchorable flag is wrong."""
    bad = events.where("n_mentions < 1 or sent_span > n_mentions")
    wrong = timexes.where(F.col("anchorable") != F.col("timex_type").isin(*V.ANCHORABLE))
    return _violations(bad, "event_node", "ev", "n_mentions", "sent_span").unionByName(_violations(wrong, "timex_node", "tx", "timex_type"))


def pair_consistency(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Anchored pairs that list an anchor one of their events lacks, a wrong number of anchors, or no roles."""
    rows = pairs.select("doc", "a", "b", "n_anchors", "roles", F.split("anchors", ",").alias("list"))
    wrong = rows.where((F.size("list") != F.col("n_anchors")) | (F.col("roles") == "")).select("doc", "a", "b", F.lit("count").alias("anchor"))
    listed = rows.select("doc", "a", "b", F.explode("list").alias("anchor"))
    have = edges.select("doc", "s", "anchor").distinct()
    missing = [listed.join(have.withColumnRenamed("s", end), ["doc", end, "anchor"], "left_anti").select("doc", "a", "b", "anchor") for end in ("a", "b")]
    return _violations(reduce(DataFrame.unionByName, [wrong, *missing]).distinct(), "pair", "a", "b", "anchor")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts by key on both sides and their difference."""
    a, b = (df.groupBy(key).agg(F.count(F.lit(1)).alias(name)) for df, name in ((left, "n_left"), (right, "n_right")))
    both = a.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_left", "n_right")])
    return both.withColumn("diff", F.col("n_left") - F.col("n_right"))


def report(violations: list[DataFrame], first: int = 3) -> DataFrame:
    """``(check, n, example_rank, doc, what)``: the first violations of each check with the check's total."""
    rows = reduce(DataFrame.unionByName, violations)
    totals = rows.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.withColumn("example_rank", F.row_number().over(W.partitionBy("check").orderBy("doc", "what")))
    return ranked.where(F.col("example_rank") <= first).join(totals, "check").select("check", "n", F.col("example_rank").cast("long").alias("example_rank"), "doc", "what")
