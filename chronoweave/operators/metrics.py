"""Counts and scores of predictions ``(gold, pred)`` and of repairs ``(gold, obs, fin)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import vocabulary as V


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """``(by..., gold, pred, n)``; rows with a column ``c`` count that often."""
    return rows.groupBy(*by, "gold", "pred").agg((F.sum("c") if "c" in rows.columns else F.count(F.lit(1))).alias("n"))


def per_label(counts: DataFrame, labels: tuple[str, ...] = V.RELATIONS) -> DataFrame:
    """``(label, hit, said, gold_n, p, r, f1)`` of a confusion, every label a row."""
    spark = counts.sparkSession
    true = counts.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("gold_n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    said = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    rows = spark.createDataFrame([(r,) for r in labels], "label string").join(true, "label", "left").join(said, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    hit, s, g = F.col("hit"), F.col("said"), F.col("gold_n")
    return rows.select("label", "hit", "said", "gold_n", ratio(hit, s).alias("p"), ratio(hit, g).alias("r"), ratio(2 * hit, s + g).alias("f1"))


def summary(counts: DataFrame, labels: tuple[str, ...] = V.RELATIONS) -> DataFrame:
    """``(macro_f1, accuracy, n)``: macro over all labels, absent ones count zero."""
    one = per_label(counts, labels)
    return one.agg(F.avg("f1").alias("macro_f1"), (F.sum("hit") / F.sum("gold_n")).alias("accuracy"), F.sum("gold_n").alias("n"))


def by_kind_and_all(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """``(kind, label, hit, said, gold_n, f1)`` for each kind and for all, from one pass of grouping sets."""
    true = rows.groupingSets([[kind, "gold"], ["gold"]], kind, "gold").agg(F.count(F.lit(1)).alias("gold_n"), F.count_if(F.col("gold") == F.col("pred")).alias("hit"))
    said = rows.groupingSets([[kind, "pred"], ["pred"]], kind, "pred").agg(F.count(F.lit(1)).alias("said"))
    a = true.select(F.coalesce(kind, F.lit("all")).alias("kind"), F.col("gold").alias("label"), "gold_n", "hit")
    b = said.select(F.coalesce(kind, F.lit("all")).alias("kind"), F.col("pred").alias("label"), "said")
    both = a.join(b, ["kind", "label"], "full").na.fill(0)
    return both.select("kind", "label", "hit", "said", "gold_n", (2 * F.col("hit") / (F.col("said") + F.col("gold_n"))).alias("f1"))


def repair_score(rows: DataFrame, *by: str) -> DataFrame:
    """Of ``(gold, obs, fin)``: edges, wrong before and after, flagged, hit, fixed, broken, net, detection P, R and F1."""
    wrong, changed = F.col("obs") != F.col("gold"), F.col("obs") != F.col("fin")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(wrong).alias("wrong_before"),
        F.count_if(F.col("fin") != F.col("gold")).alias("wrong_after"),
        F.count_if(changed).alias("flagged"),
        F.count_if(changed & wrong).alias("hit"),
        F.count_if(wrong & (F.col("fin") == F.col("gold"))).alias("fixed"),
        F.count_if(~wrong & (F.col("fin") != F.col("gold"))).alias("broken"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumns({"net": F.col("fixed") - F.col("broken"), "det_p": ratio("hit", "flagged"), "det_r": ratio("hit", "wrong_before")})
    both = F.col("det_p") + F.col("det_r")
    return out.withColumn("det_f1", F.when(both > 0, 2 * F.col("det_p") * F.col("det_r") / both).otherwise(0.0))


def label_census(edges: DataFrame, split: Column) -> DataFrame:
    """``(split, rel, n, docs)``."""
    return edges.groupBy(split.alias("split"), "rel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"))


def cue_table(atoms: DataFrame, cues: DataFrame) -> DataFrame:
    """``(cue, rel, n)``: labels of the instances that hold all of a cue's required atoms and none of its forbidden ones.

    ``cues`` is ``(cue, required, forbidden)`` with arrays; it is a short list and is broadcast.
    """
    listed = cues.select("cue", F.explode("required").alias("atom"), F.size("required").alias("need"))
    met = atoms.join(F.broadcast(listed), "atom").groupBy("doc", "s", "t", "rel", "cue").agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need")).where("met = need")
    banned = atoms.join(F.broadcast(cues.select("cue", F.explode("forbidden").alias("atom"))), "atom").select("doc", "s", "t", "cue").distinct()
    return met.join(banned, ["doc", "s", "t", "cue"], "left_anti").groupBy("cue", "rel").agg(F.count(F.lit(1)).alias("n"))


def concentration(edges: DataFrame, label: str, top: int = 10) -> DataFrame:
    """``(n, docs, most_in_a_doc, top_share)``: how a label gathers in documents."""
    per = edges.where(F.col("rel") == label).groupBy("doc").agg(F.count(F.lit(1)).alias("c"))
    ranked = per.orderBy(F.desc("c"), "doc").limit(top).agg(F.sum("c").alias("t"))
    return per.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"), F.max("c").alias("most_in_a_doc")).crossJoin(ranked).select("n", "docs", "most_in_a_doc", (F.col("t") / F.col("n")).alias("top_share"))


def majority_baseline(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """``(kind, label, n, accuracy)``: each kind's most frequent label, ties by name, and what saying it always scores."""
    counts = rows.groupBy(kind, "gold").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(kind)
    ranked = counts.withColumns({"r": F.row_number().over(w.orderBy(F.desc("c"), "gold")), "n": F.sum("c").over(w)})
    return ranked.where("r = 1").select(kind, F.col("gold").alias("label"), "n", (F.col("c") / F.col("n")).alias("accuracy"))
