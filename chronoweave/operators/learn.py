"""The learned baseline: multinomial logistic regression on an instance's atoms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import combining as CB

#: Offsets that are tried for a label.
OFFSET_GRID = tuple(-2.0 + 0.25 * i for i in range(33))


def label_model(train: DataFrame, least_rows: float = 5.0, l2: float = 1e-6, rounds: int = 50) -> tuple[Callable[[DataFrame], DataFrame], list[str]]:
    """A regression on atoms of ``least_rows`` training rows: what gives ``gold`` and ``scores`` of rows, and the labels in order.

    Rows are ``(rel, atoms)``; with a column ``c`` a row stands for so many instances.  Other columns are kept.
    """
    train = train.withColumn("c", F.col("c").cast("double") if "c" in train.columns else F.lit(1.0))
    often = train.select("c", F.explode(F.array_distinct("atoms")).alias("atom")).groupBy("atom").agg(F.sum("c").alias("n")).where(F.col("n") >= least_rows)
    known = [r["atom"] for r in often.orderBy(F.desc("n"), "atom").collect()]  # the model's vocabulary
    labels = StringIndexer(inputCol="rel", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(train)
    vectors = CountVectorizerModel.from_vocabulary(known, inputCol="atoms", outputCol="features", binary=True)
    encode = lambda rows: vectors.transform(labels.transform(rows))
    model = LogisticRegression(family="multinomial", regParam=l2, maxIter=rounds, weightCol="c").fit(encode(train))

    def scored(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("rel", "atoms")]
        return model.transform(encode(rows)).select(*kept, F.col("rel").alias("gold"), vector_to_array("rawPrediction").alias("scores"))

    return scored, list(labels.labels)


def best_scored(names: list[str], offsets: list[float | Column] | None = None) -> Column:
    """The label of the largest of ``scores`` plus its offset; ties to the label first in order."""
    offsets = offsets or [0.0] * len(names)
    options = [F.struct((F.col("scores")[j] + offsets[j]).alias("v"), F.lit(-j).alias("j"), F.lit(r).alias("rel")) for j, r in enumerate(names)]
    return F.array_max(F.array(*options))["rel"]


def logistic_regression(train: DataFrame, test: DataFrame, least_rows: float = 5.0, l2: float = 1e-6, rounds: int = 50) -> DataFrame:
    """``gold`` and ``pred`` of ``test`` from atoms that occur on ``least_rows`` training rows."""
    scored, names = label_model(train, least_rows, l2, rounds)
    return scored(test).withColumn("pred", best_scored(names)).drop("scores")


def tune_offsets(scored: DataFrame, names: list[str], grid: tuple[float, ...] = OFFSET_GRID, rounds: int = 3) -> tuple[list[float], float]:
    """Offsets of the labels' scores by coordinate ascent on macro F1; the first label's stays zero.

    ``scored`` is ``(gold, scores)``, with ``c`` where a row stands for more.  One aggregate scores the whole grid of a label; the earlier value wins a tie.
    """
    counted = scored.withColumn("n", F.col("c") if "c" in scored.columns else F.lit(1))
    offsets: list[float] = [0.0] * len(names)
    best = CB.macro_f1(counted, best_scored(names))
    for _ in range(rounds):
        for at in range(1, len(names)):
            found = CB.macro_by_trial(counted, list(grid), best_scored(names, [*offsets[:at], F.col("_trial"), *offsets[at + 1 :]]))
            for value in grid:
                if found.get(value, 0.0) > best:
                    best, offsets = found[value], [*offsets[:at], value, *offsets[at + 1 :]]
    return offsets, best
