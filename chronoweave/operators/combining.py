"""From fired rules to labels: combiners, floors and their tuning, compression of rule sets.

Fired rules come as ``(doc, s, t, gold, rule_id, rel, w)``, one row for each rule that fires on an instance.  Ties go to the
label that comes first by name; within a label to the smaller rule id.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import vocabulary as V

INSTANCE = ["doc", "s", "t"]


def strongest_per_label(fired: DataFrame) -> DataFrame:
    """The strongest rule of each label on each instance; all that the floors and the largest weight need."""
    best = F.min(F.struct((-F.col("w")).alias("neg"), "rule_id"))
    return fired.groupBy(*INSTANCE, "gold", "rel").agg(best.alias("b")).select(*INSTANCE, "gold", "rel", F.col("b.rule_id").alias("rule_id"), (-F.col("b.neg")).alias("w"))


def label_scores(fired: DataFrame, method: str, priors: DataFrame | None = None) -> DataFrame:
    """``(doc, s, t, gold, rel, score)`` by one of: argmax, sum, count, norm, max-norm, log-odds.

    norm and max-norm weigh by the label's prior ``(rel, prior)``, which is small and is broadcast.
    """
    rows = fired
    if method in ("norm", "max-norm"):
        rows = rows.join(F.broadcast(priors), "rel").withColumn("w", F.col("w") / F.col("prior"))
    clamped = F.least(F.greatest(F.col("w"), F.lit(1e-4)), F.lit(1 - 1e-4))
    how = {
        "argmax": F.max("w"),
        "sum": F.sum("w"),
        "count": F.count(F.lit(1)).cast("double"),
        "norm": F.sum("w"),
        "max-norm": F.max("w"),
        "log-odds": F.sum(F.log(clamped / (1 - clamped))),
    }[method]
    return rows.groupBy(*INSTANCE, "gold", "rel").agg(how.alias("score"))


def best_label(scores: DataFrame, threshold: float | Column = float("-inf")) -> DataFrame:
    """``(doc, s, t, gold, pred, score)`` of the best label, where it reaches the threshold.  Scores are compared to nine decimals."""
    rank = F.row_number().over(W.partitionBy(*INSTANCE).orderBy(F.desc(F.round("score", 9)), "rel"))
    rows = scores.withColumn("_r", rank).where("_r = 1")
    return rows.where(F.col("score") >= threshold).select(*INSTANCE, "gold", F.col("rel").alias("pred"), "score")


def with_fallback(instances: DataFrame, predicted: DataFrame, fallback: str | Column = V.MAJORITY) -> DataFrame:
    """All instances ``(doc, s, t, gold)`` with the prediction, or the fallback where no rule decides."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return instances.join(predicted.select(*INSTANCE, "pred"), INSTANCE, "left").withColumn("pred", F.coalesce("pred", fallback))


def top_share(scores: DataFrame, share: float) -> DataFrame:
    """The scores in the top share of their label's.

    Ranks are made over a label's distinct scores, which come with their counts; a row is kept by its label's least score.
    """
    value, w = F.round("score", 9), W.partitionBy("rel")
    per = scores.groupBy("rel", value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = per.withColumns({"_r": F.sum("c").over(w.orderBy(F.desc("v"))) - F.col("c") + 1, "_n": F.sum("c").over(w)})
    least = ranked.where(F.col("_r") <= F.ceil(F.lit(share) * F.col("_n"))).groupBy("rel").agg(F.min("v").alias("_v"))
    return scores.join(F.broadcast(least), "rel").where(value >= F.col("_v")).select(*scores.columns)


def above_floors(strongest: DataFrame, floors: DataFrame) -> DataFrame:
    """The strongest label among those whose weight reaches the label's floor ``(rel, floor)``."""
    rows = strongest.join(F.broadcast(floors), "rel").where(F.col("w") >= F.col("floor"))
    return best_label(rows.withColumnRenamed("w", "score"))


def most_specific(fired: DataFrame) -> DataFrame:
    """The rule with the most conditions, then the largest weight, then the smallest id."""
    rank = F.row_number().over(W.partitionBy(*INSTANCE).orderBy(F.desc("n_conds"), F.desc("w"), "rule_id"))
    return fired.withColumn("_r", rank).where("_r = 1").select(*INSTANCE, "gold", F.col("rel").alias("pred"), "rule_id")


def weight_profile(instances: DataFrame, strongest: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Distinct rows of the labels' best weights with the gold label and how often they occur; all that tuning reads."""
    wide = strongest.groupBy(*INSTANCE).pivot("rel", list(labels)).agg(F.max("w"))
    rows = instances.join(wide, INSTANCE, "left")
    return rows.groupBy("gold", *labels).agg(F.count(F.lit(1)).alias("n"))


def decide(labels: list[str], floors: dict[str, float]) -> Column:
    """Label by floors over a weight profile's columns."""
    candidates = F.array(*[F.when(F.col(f"`{r}`") >= floors.get(r, 9.0), F.struct((-F.col(f"`{r}`")).alias("neg"), F.lit(r).alias("rel"))) for r in labels])
    return F.coalesce(F.array_min(F.array_compact(candidates))["rel"], F.lit(V.MAJORITY))


def _macro(cells: Iterable[tuple[str, str, int]], labels: Iterable[str]) -> float:
    """Macro F1 over labels from ``(gold, pred, n)``; an absent label counts zero."""
    cells, total, labels = list(cells), 0.0, list(labels)
    for r in labels:
        hit = sum(n for g, p, n in cells if g == r == p)
        said, true = sum(n for _, p, n in cells if p == r), sum(n for g, _, n in cells if g == r)
        total += 2 * hit / (said + true) if hit else 0.0
    return total / len(labels)


def macro_f1(counts: DataFrame, pred: Column, labels: Iterable[str] = V.RELATIONS) -> float:
    """Macro F1 over all labels of rows ``(gold, n)``; an absent label counts zero."""
    rows = counts.withColumn("pred", pred).groupBy("gold", "pred").agg(F.sum("n").alias("n")).collect()  # labels squared
    return _macro(rows, labels)


def macro_by_trial(counts: DataFrame, trials: list[float], pred: Column, labels: Iterable[str] = V.RELATIONS) -> dict[float, float]:
    """Macro F1 of rows ``(gold, n)`` for each value that ``pred`` reads as the column ``_trial``; one aggregate for all of them."""
    rows = counts.withColumn("_trial", F.explode(F.array(*[F.lit(float(x)) for x in trials]))).withColumn("pred", pred)
    cells: dict[float, list] = {}
    for r in rows.groupBy("_trial", "gold", "pred").agg(F.sum("n").alias("n")).collect():  # labels squared for each trial
        cells.setdefault(r["_trial"], []).append((r["gold"], r["pred"], r["n"]))
    return {x: _macro(c, labels) for x, c in cells.items()}


#: Floors that are tried; 9 is a floor that no weight reaches.
FLOOR_GRID = (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 9.0)


#: Values that one aggregate tries at most.
TRIALS = 200


def tune_floors(profile: DataFrame, labels: list[str], grid: tuple[float, ...] | None = FLOOR_GRID, start: float = 9.0, rounds: int = 3) -> tuple[dict[str, float], float]:
    """Floors by coordinate ascent on macro F1; a profile is counts of distinct rows, so a step is a small aggregate.

    One aggregate scores the values that are tried for a label.  Without a grid each label tries the weights that it has in the
    profile, and 9; they are as many as its rules at most.
    """
    floors = dict.fromkeys(labels, start)
    best = macro_f1(profile, decide(labels, floors))
    observed = lambda r: [x[0] for x in profile.select(F.col(f"`{r}`")).where(F.col(f"`{r}`").isNotNull()).distinct().orderBy(f"`{r}`").collect()] + [9.0]
    tried = {r: list(grid) if grid is not None else observed(r) for r in labels}
    for _ in range(rounds):
        before = dict(floors)
        for r in labels:
            values = [x for x in tried[r] if x != floors[r]]
            for at in range(0, len(values), TRIALS):
                part = values[at : at + TRIALS]
                scores = macro_by_trial(profile, part, decide(labels, floors | {r: F.col("_trial")}))
                for value in part:
                    if scores.get(float(value), 0.0) > best:
                        best, floors = scores[float(value)], floors | {r: value}
        if floors == before:
            break
    return floors, best


def dead_rules(rules: DataFrame, floors: DataFrame) -> DataFrame:
    """Rules that their label's floor lets vote; the others can never decide."""
    return rules.join(F.broadcast(floors), "rel").where(F.col("w") >= F.col("floor")).drop("floor")


def extension_classes(fired: DataFrame) -> DataFrame:
    """``(rel, extension, n_rules, first_rule, n)``: rules of a label that fire on the same instances.

    An extension is the count and two sums of independent hashes of its instances, so no set is gathered anywhere.
    """
    h = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in INSTANCE]).cast("binary")), 1, 8), 16, 10).cast("bigint")
    per = fired.groupBy("rel", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum(h("a")).alias("ha"), F.sum(h("b")).alias("hb"))
    return per.groupBy("rel", "n", F.concat_ws(":", F.col("ha").cast("string"), F.col("hb").cast("string")).alias("extension")).agg(F.count(F.lit(1)).alias("n_rules"), F.min("rule_id").alias("first_rule"))


def constraint_sets(strongest: DataFrame, fired: DataFrame, correct_only: bool = False) -> DataFrame:
    """``(doc, s, t, rule_id)``: the rules of the deciding label that beat the best rule of every other label.

    Keeping one of each instance's set keeps its label.
    """
    winner = best_label(strongest.withColumnRenamed("w", "score")).select(*INSTANCE, F.col("pred").alias("rel"), F.col("gold").alias("g"))
    if correct_only:
        winner = winner.where("rel = g")
    other = strongest.join(winner.select(*INSTANCE, F.col("rel").alias("won")), INSTANCE).where("rel <> won").groupBy(*INSTANCE).agg(F.max("w").alias("bar"))
    rows = fired.join(winner.select(*INSTANCE, "rel"), [*INSTANCE, "rel"]).join(other, INSTANCE, "left")
    return rows.where(F.col("bar").isNull() | (F.col("w") > F.col("bar"))).select(*INSTANCE, "rule_id")


def distinct_constraints(constraints: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(rules, n)``: the distinct sets and how many instances each speaks for; ``weights`` is ``(doc, s, t, c)`` where instances stand for more."""
    sets = constraints.groupBy(*INSTANCE).agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    if weights is not None:
        return sets.join(weights, INSTANCE).groupBy("rules").agg(F.sum("c").alias("n"))
    return sets.groupBy("rules").agg(F.count(F.lit(1)).alias("n"))


def cover(sets: list[list]) -> tuple[list, int]:
    """A small set of rules that meets every constraint, and a lower bound on its size.

    Forced rules first, then greedy by the constraints that they meet, then reverse deletion; the bound is a packing of
    disjoint constraints.  Sequential by nature, over the distinct minimal sets only.
    """
    distinct = sorted({tuple(sorted(s)) for s in sets}, key=lambda s: (len(s), s))
    minimal: list[tuple] = []
    for s in distinct:
        if not any(set(m) <= set(s) for m in minimal):
            minimal.append(s)
    chosen = {s[0] for s in minimal if len(s) == 1}
    open_ = [set(s) for s in minimal if not chosen & set(s)]
    order = list(sorted(chosen))
    while open_:
        gains: dict = {}
        for s in open_:
            for r in s:
                gains[r] = gains.get(r, 0) + 1
        best = min(gains, key=lambda r: (-gains[r], r))
        order.append(best)
        open_ = [s for s in open_ if best not in s]
    for r in reversed(list(order)):
        rest = set(order) - {r}
        if all(rest & set(s) for s in minimal):
            order.remove(r)
    packed, used = 0, set()
    for s in minimal:
        if not used & set(s):
            used |= set(s)
            packed += 1
    return sorted(order), packed


def template_counts(rules: DataFrame) -> DataFrame:
    """Rules by label and by the attributes that they test."""
    attributes = F.transform(F.split("conds", " & "), lambda c: F.concat_ws("|", F.get(F.split(c, r"\|"), 0), F.get(F.split(c, r"\|"), 1)))
    return rules.groupBy("rel", F.array_join(F.array_sort(attributes), " & ").alias("template")).agg(F.count(F.lit(1)).alias("n"))


def near_rules(fired: DataFrame, least: float = 0.8) -> DataFrame:
    """``(a, b, jaccard)``: rules of a label whose instances overlap by the Jaccard measure; single linkage joins them.

    An instance's rules are paired inside its row; with a column ``c`` it counts that often.
    """
    count = F.sum("c") if "c" in fired.columns else F.count(F.lit(1))
    size = fired.groupBy("rel", "rule_id").agg(count.alias("n"))
    sets = fired.groupBy(*INSTANCE, "rel", *[c for c in ("c",) if c in fired.columns]).agg(F.array_sort(F.collect_set("rule_id")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    common = sets.withColumn("p", F.explode(pairs)).groupBy("p.a", "p.b").agg(count.alias("c"))
    rows = common.join(size.select(F.col("rule_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("rule_id").alias("b"), F.col("n").alias("nb")), "b")
    return rows.withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where(F.col("jaccard") >= least).select("a", "b", "jaccard")
