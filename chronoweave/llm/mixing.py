"""Mixing to target weights with soft membership (operator 3), in DataFrame functions only.

A classifier fitted on a labelled table gives each document its posterior over domains.  Nonnegative document rates are then
fitted so that the expected tokens of each domain, the sum of rate x tokens x posterior, come to the target shares of the
corpus' tokens.  The fit is accelerated projected gradient descent on the relative squared error of the totals, with a small pull
of each rate to one: a round needs the domain totals only, one aggregate over all documents that brings one number for each domain to
the driver, and a document's rate is a fold over the rounds' residuals, so no round writes anything.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import cut

# The domains of the ``labels`` table and the shares of tokens that the mixture aims at.
TARGETS = {"good": 0.90, "low": 0.08, "toxic": 0.02}

#: Labelled rows that the classifier is fitted on, about; the sample is a fixed function of doc_id.
SAMPLE_ROWS = 20_000
#: Labelled documents that must hold a word before it is evidence.
LEAST_DOCUMENTS = 5
EVIDENCE = 25.0
#: Words in the model up to which they stand in the plan, and up to which it is broadcast; a larger one is joined.
LITERAL_WORDS, BROADCAST_WORDS = 4_000, 200_000
#: So small that a rate of 20 moves its domain's total by 0.02 %.
PULL = 1e-5
CALIBRATION_ROUNDS = 8
#: Rates have no upper bound.
MOST_RATE = math.inf
MOST_ROUNDS, STALLED = 60, 1e-7
#: Difference of a total from its target, relative to the target, from which a warning says that the fit ended short of it.
UNMET = 0.01


def with_evidence(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``n``, the number of words, and ``e``: the distinct words and three marks of the text's surface.

    Words are lower-case runs of letters.  Marks, which start with a hash sign, give in coarse steps the share of capitals, the
    share of other characters than letters, and the share of different words at a length.
    """
    text = F.coalesce("text", F.lit(""))
    # the words are a column of their own, so that they are cut once and not for each of their uses
    rows = docs.select(*keep, F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "").alias("w"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("capitals"), F.greatest(F.length(text), F.lit(1)).alias("length"))
    rows = rows.select(*keep, F.size("w").alias("n"), F.array_distinct("w").alias("w"), F.length(F.array_join("w", "")).alias("letters"), "capitals", "length")
    step = lambda share: F.floor(F.round(share * 25)).cast("string")
    variety = F.floor(20 * F.size("w") / F.greatest(F.col("n"), F.lit(1))).cast("string")
    marks = (
        F.concat(F.lit("#capitals "), step(F.col("capitals") / F.col("length"))),
        F.concat(F.lit("#other "), step(1 - F.col("letters") / F.col("length"))),
        F.concat(F.lit("#variety "), variety, F.lit(" of "), F.floor(F.log2(F.col("n") + 1.0)).cast("string")),
    )
    return rows.select(*keep, "n", F.concat("w", F.array(*marks)).alias("e"))


def label_domain() -> Column:
    """Domain of a row of ``labels``: toxic rows, else by quality; null where the row says neither."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], bound: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[str, float]]:
    """``(word, <a weight for each domain>)`` and the domains' log priors, from ``labelled(doc_id, domain)``.

    A word's weight for a domain is the log ratio of its document frequency there and elsewhere; zero unless the ratio is one
    or more and its likelihood ratio statistic reaches ``EVIDENCE``, since many words are tried.  A document labelled twice counts once, as its first
    domain by name.
    """
    labelled = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    share = bound / max(1, labelled.count())
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # the sample is bounded, so it may be broadcast and the texts stay where they are
    sample = F.broadcast(labelled.groupBy("doc_id").agg(F.min("domain").alias("domain")))
    found = cut(with_evidence(docs.select("doc_id", "text").join(sample, "doc_id"), "doc_id", "domain"))
    per_word = found.select("domain", F.explode("e").alias("w")).groupBy(F.col("w").alias("word")).agg(*[F.count_if(F.col("domain") == d).alias(d) for d in domains])
    totals = found.groupBy("domain").count().collect()  # a row a domain
    n = {d: 0 for d in domains} | {r["domain"]: r["count"] for r in totals}
    every = sum(n.values())
    seen = sum(F.col(d) for d in domains)

    def weight(d: str) -> Column:
        a, b = F.col(d), seen - F.col(d)
        share = min(max(n[d] / max(every, 1), 1e-6), 1 - 1e-6)
        surprise = lambda x, p: F.when(x > 0, x * F.log(x / (seen * p))).otherwise(0.0)
        ratio = F.log((a + 0.5) / (n[d] + 1)) - F.log((b + 0.5) / (every - n[d] + 1))
        telling = (F.abs(ratio) >= 1) & (2 * (surprise(a, share) + surprise(b, 1 - share)) >= EVIDENCE)
        return F.when(telling, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), ratio))).otherwise(0.0)

    model = per_word.where(seen >= LEAST_DOCUMENTS).select("word", *[weight(d).alias(d) for d in domains])
    model = cut(model.where(sum(F.abs(F.col(d)) for d in domains) > 0))
    share = {d: (n[d] + 0.5) / (every + 0.5 * len(domains)) for d in domains}
    priors = {d: math.log(share[d]) for d in domains}
    if every:
        # words that are absent say nothing here, so the priors are moved until the mean posteriors of the sample are its shares
        seen_scores = cut(scores(found, model, domains))
        for _ in range(CALIBRATION_ROUNDS):
            mean = posteriors(seen_scores, priors).agg(*[F.avg(f"p_{d}").alias(d) for d in domains]).first()
            if mean[0] is None:
                break
            priors = {d: priors[d] + math.log(share[d] / max(mean[d], 1e-9)) for d in domains}
    return model, priors


def scores(texts: DataFrame, model: DataFrame, domains: list[str]) -> DataFrame:
    """``(doc_id, n_tokens, <a sum of weights for each domain>)`` of rows with evidence: one
    for each doc_id; rows of one id are one document."""
    known = model.count()
    told = F.col("e")
    if known <= LITERAL_WORDS:
        # only evidence that the model knows leaves its row; a larger model is met by the join alone
        told = F.array_intersect("e", F.lit([r["word"] for r in model.select("word").orderBy("word").collect()]).cast("array<string>"))
    rows = texts.select("doc_id", "n", F.posexplode_outer(told).alias("at", "word"))
    rows = rows.select("doc_id", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n")).otherwise(0).alias("n"), "word")
    rows = rows.join(F.broadcast(model) if known <= BROADCAST_WORDS else model, "word", "left")
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), *[F.coalesce(F.sum(d), F.lit(0.0)).alias(d) for d in domains])


def posteriors(scored: DataFrame, priors: dict[str, float]) -> DataFrame:
    """``(doc_id, n_tokens, p_<domain>...)`` of ``scores``; a text without words has no tokens and little to tell its domain."""
    domains = list(priors)
    logit = {d: F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.col(d))) + priors[d] for d in domains}
    top = F.greatest(*logit.values()) if len(domains) > 1 else logit[domains[0]]
    odds = scored.select("doc_id", "n_tokens", *[F.exp(logit[d] - top).alias(d) for d in domains])
    total = sum(F.col(d) for d in domains)
    return odds.select("doc_id", "n_tokens", *[(F.col(d) / total).alias(f"p_{d}") for d in domains])


def fit_rates(members: DataFrame, targets: dict[str, float], tolerance: float = 1e-4) -> DataFrame:
    """``members`` with a column ``rate``: zero or more, so that the domains' expected tokens meet the targets.

    ``targets`` are shares of all tokens; they are scaled to sum to one.  A corpus without tokens keeps the rate one.
    Targets that the posteriors do not allow, such as one for a domain without tokens, are told in a warning.
    """
    domains = list(targets)
    whole = sum(targets.values())
    goal = [targets[d] / whole for d in domains]
    member = [F.col(f"p_{d}") for d in domains]
    steps: list[list[float]] = []  # for each round the residuals' weights, and the momentum

    def state() -> Column:
        """Rate and look-ahead point of a document after the rounds so far."""
        history = F.array(*[F.array(*map(F.lit, s)) for s in steps]) if steps else F.array().cast("array<array<double>>")
        first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("y"))

        def step(at: Column, s: Column) -> Column:
            y = at["y"] - sum(p * s[k] for k, p in enumerate(member)) - PULL * (at["y"] - 1)
            w = F.greatest(F.lit(0.0), y)
            return F.struct(w.alias("w"), (w + s[len(domains)] * (w - at["w"])).alias("y"))

        return F.aggregate(history, first, step)

    # a rate depends on the posterior alone, so documents of equal posterior are one row of the fit
    grouped = cut(members.groupBy(*member).agg(F.sum("n_tokens").alias("n_tokens")))
    all_tokens = grouped.agg(F.sum("n_tokens").alias("n")).first()["n"]
    if not all_tokens:
        return members.withColumn("rate", F.lit(1.0))
    start, least, momentum = None, None, 1.0
    for _ in range(MOST_ROUNDS):
        weighed = grouped.select(state().alias("at"), "n_tokens", *member)
        sums = weighed.agg(*[F.sum(F.col(f"at.{c}") * F.col("n_tokens") * F.col(f"p_{d}")).alias(f"{c}_{d}") for c in "wy" for d in domains]).first()
        now, ahead = ([sums[f"{c}_{d}"] / all_tokens for d in domains] for c in "wy")
        # relative errors: in them the steepest direction has curvature one, so steps of length one are safe
        start = start or [max(x, 1e-9) for x in now]
        error = sum((x - g) ** 2 / s for x, g, s in zip(now, goal, start))
        if all(abs(x - g) < tolerance and abs(x - g) <= UNMET / 2 * g for x, g in zip(now, goal)):
            break
        if least is not None and abs(least - error) <= STALLED:
            break  # as near as the posteriors allow
        if least is not None and error > least:
            momentum = 1.0  # it overshot: gather speed anew
        least = error
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        steps.append([*((x - g) / s for x, g, s in zip(ahead, goal, start)), (momentum - 1) / following])
        momentum = following
    unmet = {d: (round(x, 6), g) for d, x, g in zip(domains, now, goal) if abs(x - g) > UNMET * g}
    if unmet:
        warnings.warn(f"shares of tokens and their targets that the rates do not meet: {unmet}", stacklevel=2)
    return members.withColumn("rate", state()["w"])


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, p_<domain>..., rate, copies)`` of every document.

    ``copies`` turns the rate into a whole number whose expectation it is: its floor, and one more for the share of ids whose
    hash is below the rest.  Null and empty texts have no tokens; labels of unknown documents do nothing; without labels the
    posteriors are even.  Extra columns are ignored.
    """
    targets = targets or TARGETS
    model, priors = fit_classifier(docs, labelled, list(targets))
    rated = fit_rates(cut(posteriors(scores(with_evidence(docs, "doc_id"), model, list(priors)), priors)), targets)
    chance = F.crc32(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) / float(1 << 32)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def apply_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, keep: str | None = None) -> DataFrame:
    """``docs`` with each row as often as the ``copies`` of its document; the columns of ``docs``, whatever their names.

    Documents whose likeliest domain is ``keep`` stay once at least, whatever their rate.  Rows that repeat an id, or have
    none, are one document, and each of them comes as often as it does.  Null and empty texts have no tokens and go by the
    rate of their posterior like others.  An empty table stays empty.
    """
    rated = mix(docs, labelled, targets)
    if keep is not None:
        likeliest = F.col(f"p_{keep}") >= F.greatest(F.lit(0.0), *[F.col(c) for c in rated.columns if c.startswith("p_")])
        rated = rated.withColumn("copies", F.when(likeliest, F.greatest("copies", F.lit(1))).otherwise(F.col("copies")))
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("mix_id", "mix_copies", "mix_copy"):
        while name in taken:
            name += "_"
        names.append(name)
    key, copies, copy = names
    rated = rated.select(F.col("doc_id").alias(key), F.col("copies").alias(copies)).where(F.col(copies) > 0)
    rows = docs.join(rated, F.col("doc_id").eqNullSafe(F.col(key)))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
