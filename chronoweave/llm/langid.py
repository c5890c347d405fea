"""Language identification as a mixture: EM over character trigram likelihoods, the set chosen by penalised likelihood
(operator 4).

Letters of a text become small classes, any run of other characters one gap, and trigrams of classes are hashed to a fixed
number of buckets.  Each language is a smoothed distribution over the buckets.  A document's trigrams are taken as drawn from
a mixture of languages; EM estimates the proportions, and a language joins the document's set only while it raises the
log-likelihood by more than a penalty that grows with the logarithm of the length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import fold, map_frames

BITS = 15
BUCKETS = 1 << BITS
#: Labelled rows that the model is fitted on, about; the sample is a fixed function of doc_id.
SAMPLE_ROWS = 20_000
UNDETERMINED = "und"
#: Standard deviation of a trigram's log-likelihood under a language, about.
SPREAD = 3.5


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """For each code point 0 (no letter) or the class of its lower-case letter: a-z and Latin-1 their own, others hashed."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            if 97 <= low <= 122:
                table[cp] = low - 96
            elif 0xDF <= low <= 0xFF:
                table[cp] = low - 0xDF + 27
            else:
                table[cp] = 60 + (low * 2654435761 >> 8) % 196
    return table


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and their counts over the whole text; None for a text without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letter_classes()[points]
    if not c.any():
        return None
    c = np.concatenate([np.zeros(1, np.uint8), c, np.zeros(1, np.uint8)])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    c = c[keep].astype(np.uint32)
    code = ((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    counts = np.bincount(code, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


@dataclass
class LanguageModel:
    languages: list[str]
    likelihood: np.ndarray  # bucket x language

    def em(self, p: np.ndarray, n: np.ndarray, rounds: int = 25, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
        """Proportions of the columns of ``p`` and the log-likelihood they reach."""
        total = n.sum()
        pi = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(rounds):
            weight = n / (p @ pi)
            new = pi * (weight @ p) / total
            done = np.abs(new - pi).max() < tolerance
            pi = new
            if done:
                break
        return pi, float(n @ np.log(p @ pi))

    def mixture(self, text: str | None, penalty: float = 4.0) -> tuple[dict[str, float], np.ndarray, float] | None:
        """Proportions over the chosen set, proportions over all languages, log-likelihood a trigram; None without a letter."""
        return self.mixture_of(trigram_counts(text), penalty)

    def mixture_of(self, counted: tuple[np.ndarray, np.ndarray] | None, penalty: float = 4.0) -> tuple[dict[str, float], np.ndarray, float] | None:
        """``mixture`` of a text's counted trigrams."""
        if counted is None or not self.languages:
            return None
        at, n = counted
        p = self.likelihood[at]
        single = n @ np.log(p)
        best, (pi, _) = int(np.argmax(single)), self.em(p, n)
        order = [best, *(i for i in np.argsort(-pi, kind="stable") if i != best)]
        chosen, proportions, reached = [best], np.ones(1), float(single[best])
        cost = penalty * np.log(n.sum() + 1)
        for i in order[1:]:
            if pi[i] < 0.02:
                break
            some, now = self.em(p[:, [*chosen, i]], n)
            if now - reached <= cost:
                break
            chosen, proportions, reached = [*chosen, i], some, now
        return {self.languages[i]: float(x) for i, x in zip(chosen, proportions)}, pi, reached / n.sum()

    def identified(self, text: str | None) -> bool:
        """Whether a text has a language: a letter, and trigrams that the mixture does not explain clearly worse than even draws.

        Clearly is five standard errors of a mean over the text's trigrams, so a short text with a key or a name in it stays.
        """
        counted = trigram_counts(text)
        found = self.mixture_of(counted)
        return found is not None and found[2] + math.log(BUCKETS) > -5 * SPREAD / math.sqrt(counted[1].sum())


def sample_shares(rows: dict[str, int], bound: int) -> dict[str, float]:
    """Share of each language's rows to take: all of the rare ones, and of the others an even number that fills the bound."""
    left, shares = bound, {}
    for i, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(rows) - i))
        shares[lang], left = take / n, left - take
    return shares


def fit(docs: DataFrame, bound: int = SAMPLE_ROWS, smoothing: float = 0.05) -> LanguageModel:
    """A model of every non-null value of ``lang``, from a sample of about ``bound`` rows spread by hash of doc_id.

    Each language has an even part of the bound, and what rarer ones leave goes to the others, so a rare language keeps all
    its rows.  Counts are summed on the executors; the driver gets one number for each language and bucket.
    """
    labelled = docs.where("lang is not null and text is not null")
    shares = sample_shares({r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}, bound)  # a row a language
    if min(shares.values(), default=1) < 1:
        share = F.create_map(*[F.lit(x) for lang, x in shares.items() for x in (lang, int(x * (1 << 30)))])
        labelled = labelled.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) < F.try_element_at(share, "lang"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if (found := trigram_counts(text)) is not None:
                    sums.setdefault(lang, np.zeros(BUCKETS))[found[0]] += found[1]
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})

    rows = labelled.select("lang", "text").mapInPandas(run, "lang string, bucket int, n double")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    counts[got["bucket"].to_numpy(int), got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = got["n"]
    counts += smoothing
    return LanguageModel(languages, counts / counts.sum(axis=0))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, mean_log_likelihood, languages)`` of every row; ``languages`` lists the chosen set.

    A null text and one without a letter are ``und`` with score 0, as is every text when the model has no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.likelihood.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, likelihood = shared.value
        local = LanguageModel(languages, likelihood.astype(np.float64))
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = local.mixture(text)
                if found is None:
                    rows.append((UNDETERMINED, 0.0, 0.0, ""))
                    continue
                chosen, pi, mean = found
                top = max(sorted(chosen), key=chosen.get)
                rows.append((top, float(min(1.0, pi[languages.index(top)])), mean, ",".join(f"{k}={v:.3f}" for k, v in sorted(chosen.items()))))
            a, b, c, d = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": list(a), "score": list(b), "mean_log_likelihood": list(c), "languages": list(d)})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, mean_log_likelihood double, languages string")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id's text modulo 3 is not 1."""
    return docs.where(fold(F.col("doc_id"), 3) != 1)


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that have no language.

    A row goes if its text is null or has no letter, or if the best mixture of languages explains its trigrams clearly worse
    than drawing buckets evenly would (``LanguageModel.identified``).
    """
    model = fit(training_rows(docs))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.likelihood.astype(np.float32)))

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, likelihood = shared.value
        local = LanguageModel(languages, likelihood.astype(np.float64))
        for batch in batches:
            yield batch.filter(pa.array([local.identified(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
