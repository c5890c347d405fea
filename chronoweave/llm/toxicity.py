"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 9).

Features are densities and counts of lexicon words (a fixed list, and words and word starts learned from labelled rows),
their closeness to second-person words, capitals, punctuation, obfuscation and repetition.  Trees and the calibration are
fitted on the driver on a bounded sample of labelled feature rows; texts stay on the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.boosting import Boosted, fit_boosted, isotonic, sigmoid
from chronoweave.llm.common import fold, map_frames

#: Labelled rows that the model is fitted on, about; the sample is a fixed function of doc_id.
SAMPLE_ROWS = 16_000
#: Labelled toxic rows that must hold a word before it is learned.
LEXICON_LEAST = 5

# Insults and second-person words of the four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool jerk creep freak ugly"
    " imbecile imbécile crétin débile abruti ordure minable salaud connard dummkopf trottel abschaum versager arschloch idioten dumm ekelhaft"
    " estúpido imbécil tonto basura escoria asqueroso payaso patético inútil perdedor".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr euer usted ustedes tú vosotros vuestro".split())
_LEET = str.maketrans("013457@$!|", "oieastasii")
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_]+[0-9@$!|*#]+[^\W\d_]+")
STARTS = (4, 5, 6, 7)
NEAR = 6

FEATURES = (
    "words", "insult_rate", "insults", "learned_rate", "learned", "learned_weight", "start_rate", "starts", "start_weight", "second_rate", "near_second",
    "capital_rate", "shout_rate", "exclaim_rate", "question_rate", "symbol_rate", "comma_rate", "digit_rate", "masked_rate", "masked_hits", "distinct_share", "repeat_share", "word_length", "line_rate",
)


@dataclass
class Lexicon:
    """Log odds of learned words and of learned word starts."""

    words: dict[str, float]
    starts: dict[str, float]
    #: Words that are in no list, as a worker has met them; when full it starts anew, which changes nothing but time.
    plain: set[str] = field(default_factory=set, repr=False, compare=False)

    def listed(self, words) -> dict[str, tuple[bool, float, float]]:
        """Of each listed word: whether it is an insult, and its weights as a word and by its start."""
        out = {}
        for w in words.keys() - self.plain:
            start = max((self.starts.get(w[:k], 0.0) for k in STARTS if len(w) > k), default=0.0)
            weight = self.words.get(w, 0.0)
            if start or weight or w in INSULTS:
                out[w] = (w in INSULTS, weight, start)
            else:
                if len(self.plain) > 500_000:
                    self.plain.clear()
                self.plain.add(w)
        return out

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        low = _WORD.findall(text.lower())
        n = len(low) or 1
        chars = len(text) or 1
        counts = Counter(low)
        bad = self.listed(counts)
        insults = sum(counts[w] for w, x in bad.items() if x[0])
        learned = sum(counts[w] for w, x in bad.items() if x[1])
        begun = sum(counts[w] for w, x in bad.items() if x[2])
        second = sum(counts[w] for w in SECOND_PERSON if w in counts)
        near = 0
        if second and bad:
            last_you = last_bad = -NEAR - 1
            for i, w in enumerate(low):
                if w in SECOND_PERSON:
                    near += i - last_bad <= NEAR
                    last_you = i
                elif w in bad:
                    near += i - last_you <= NEAR
                    last_bad = i
        masked = _MASKED.findall(text) if _MASK.search(text) else []
        hits = sum((m := w.lower().translate(_LEET)) in INSULTS or m in self.words for w in masked)
        letters = sum(map(len, low)) or 1
        capitals = sum(map(len, _CAPITALS.findall(text)))
        shout = len(_SHOUT.findall(text))
        exclaim, question, comma, lines = text.count("!"), text.count("?"), text.count(","), text.count("\n")
        digits = sum(map(len, _DIGITS.findall(text)))
        symbols = sum(map(text.count, "#$%&*@^~|<>=+"))
        top = counts.most_common(1)[0][1] if counts else 0
        return [
            math.log1p(len(low)), insults / n, math.log1p(insults), learned / n, math.log1p(learned), sum(x[1] for x in bad.values()), begun / n, math.log1p(begun), sum(x[2] for x in bad.values()),
            second / n, float(near), capitals / letters, shout / n, exclaim / chars, question / chars, symbols / chars, comma / chars, digits / chars, len(masked) / n, float(hits),
            len(counts) / n, top / n, letters / n, lines / chars,
        ]


_MASK = re.compile(r"(?<=[^\W\d_])[0-9@$!|*#]+(?=[^\W\d_])")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]+")
_SHOUT = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-Þ]{2,}(?![^\W\d_])")
_DIGITS = re.compile(r"[0-9]+")


def _terms(text: str | None) -> set[str]:
    """Words of a text, and starts of its longer words, which end in an asterisk."""
    words = {w.lower() for w in _WORD.findall(text or "")}
    return words | {w[:k] + "*" for w in words for k in STARTS if len(w) > k}


def learn_lexicon(labelled: DataFrame, least: int = LEXICON_LEAST, odds: float = 2.0) -> Lexicon:
    """Words and word starts of ``labelled(text, toxic)`` whose log odds of being in toxic rows, less a standard error, reach ``odds``.

    Terms are counted once a row and summed on the executors; only the terms that pass come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"]):
                (toxic if y else clean).update(_terms(text))
        # clean counts matter only for terms that toxic rows have somewhere, which the sum decides
        terms = list(toxic | clean)
        yield pd.DataFrame({"term": terms, "a": [toxic[t] for t in terms], "b": [clean[t] for t in terms]})

    totals = labelled.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("n")).first()
    na, nb = totals["a"], totals["n"] - totals["a"]
    if not na or not nb:
        return Lexicon({}, {})
    sums = labelled.select("text", "toxic").mapInPandas(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    score = F.log(a / (na + 1)) - F.log(b / (nb + 1)) - F.sqrt(1 / a + 1 / b)
    kept = sums.where(F.col("a") >= least).select("term", score.alias("w")).where(F.col("w") >= odds).toPandas()
    both = dict(zip(kept["term"], kept["w"]))
    return Lexicon({t: w for t, w in both.items() if t[-1] != "*"}, {t[:-1]: w for t, w in both.items() if t[-1] == "*"})


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts) -> np.ndarray:
        """Calibrated probabilities.  A small share of the trees' own probability orders rows within a calibrated step."""
        x = np.array([self.lexicon.features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        margin = self.trees.margin(x)
        if not len(self.knots[0]):
            return sigmoid(margin)
        return 0.98 * np.interp(margin, *self.knots) + 0.02 * sigmoid(margin)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic)`` of rows that may be learned from: labelled, and crc32 of the id's text modulo 5 is not 0."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").where(fold(F.col("doc_id"), 5) != 0).join(known.where(fold(F.col("doc_id"), 5) != 0), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, folds: int = 4) -> ToxicityModel:
    """Lexicon, trees and calibration from a sample of about ``bound`` labelled rows; the calibration from held-out folds."""
    share = bound / max(1, labels.where("toxic is not null").count() * 0.8)
    if share < 1:
        labels = labels.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    labelled = training_rows(docs, labels)
    # words are learned on one half and trees on the other, else the trees would trust the learned words too much
    half = F.pmod(F.xxhash64(F.concat(F.lit("half"), F.col("doc_id").cast("string"))), F.lit(2)) == 0
    lexicon = learn_lexicon(labelled.where(half))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "x": [shared.value.features(t) for t in batch["text"]]})

    got = labelled.where(~half).mapInPandas(run, "doc_id long, toxic int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    y = got["toxic"].to_numpy(np.float64)
    part = np.arange(len(y)) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        if (part == k).any():
            margin[part == k] = fit_boosted(x[part != k], y[part != k]).margin(x[part == k])
    return ToxicityModel(lexicon, fit_boosted(x, y), isotonic(margin, y))


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, score)`` of every row; null and empty texts are scored like any other, from zero counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.clip(shared.value.score(batch["text"]), 0.0, 1.0)})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, score double")
