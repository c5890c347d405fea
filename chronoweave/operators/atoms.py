"""Features of node pairs and the atoms made of them, in long form ``(doc, s, t, ..., atom)``.

An atom is one string: form, attribute and value joined by a bar.  A missing scalar gives no atom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.functions import vocabulary as V

SCALARS = ("type_a", "type_b", "sdist", "torder", "bucket_a", "bucket_b")
SETS = ("roles_a", "roles_b")


def pair_features(pairs: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Features of event pairs that no label enters; ``roles`` is ``(doc, ev, roles)`` with a sorted array, none where pairs carry them."""
    rows = pairs
    if roles is not None:
        r = lambda end, key: roles.select("doc", F.col("ev").alias(key), F.col("roles").alias(f"roles_{end}"))
        rows = pairs.join(r("a", "s"), ["doc", "s"], "left").join(r("b", "t"), ["doc", "t"], "left")
    at_a, at_b = F.struct("sent_a", "tok_a"), F.struct("sent_b", "tok_b")
    empty = F.array().cast("array<string>")
    return rows.select(
        "doc", "s", "t", "rel", "type_a", "type_b", "n_mentions_a", "n_mentions_b", "sent_a", "sent_b",
        S.distance_bucket(F.abs(F.col("sent_a") - F.col("sent_b"))).alias("sdist"),
        F.when(at_a < at_b, "fwd").when(at_a > at_b, "rev").alias("torder"),
        S.sentence_bucket(F.col("sent_a")).alias("bucket_a"),
        S.sentence_bucket(F.col("sent_b")).alias("bucket_b"),
        F.coalesce("roles_a", empty).alias("roles_a"),
        F.coalesce("roles_b", empty).alias("roles_b"),
    )


def scalar_atom(form: str, name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{form}|{name}|"), value.cast("string"))


def set_atoms(name: str, values: Column) -> Column:
    """HAS for each member, CNT for 0 or for each count up to 3 that the set reaches, ALL for one member, MIX for more."""
    size = F.size(values)
    counts = F.transform(F.filter(F.array(*[F.lit(i) for i in (1, 2, 3)]), lambda i: i <= size), lambda i: F.concat(F.lit(f"CNT|{name}|"), i.cast("string")))
    full = F.concat(
        F.transform(values, lambda v: F.concat(F.lit(f"HAS|{name}|"), v)),
        counts,
        F.array(F.when(size == 1, F.concat(F.lit(f"ALL|{name}|"), F.get(values, 0))).otherwise(F.lit(f"MIX|{name}|"))),
    )
    return F.when(size == 0, F.array(F.lit(f"CNT|{name}|0"))).otherwise(full)


def candidate_atoms() -> Column:
    """All atoms of a feature row, as an array."""
    scalars = F.array_compact(F.array(*[scalar_atom("EQ", c, F.col(c)) for c in SCALARS]))
    return F.concat(scalars, *[set_atoms(c, F.col(c)) for c in SETS])


def relational_atoms() -> Column:
    """Atoms that compare the two ends."""
    na, nb = F.col("n_mentions_a"), F.col("n_mentions_b")
    atoms = {
        "same_type": F.col("type_a").eqNullSafe(F.col("type_b")),
        "sent_gap": S.short_bucket(F.abs(F.col("sent_a") - F.col("sent_b"))),
        "a_before_b": F.col("sent_a") < F.col("sent_b"),
        "mention_cmp": F.when(na < nb, "lt").when(na > nb, "gt").otherwise("eq"),
        "role_overlap": F.arrays_overlap("roles_a", "roles_b"),
        "role_subset": F.size(F.array_except("roles_a", "roles_b")) == 0,
    }
    return F.array_compact(F.array(*[scalar_atom("REL", k, v) for k, v in atoms.items()]))


def explode_atoms(features: DataFrame, atoms: Column, keep: tuple[str, ...] = ("doc", "s", "t", "rel")) -> DataFrame:
    return features.select(*keep, F.explode(F.array_distinct(atoms)).alias("atom"))


def nearest(nodes: DataFrame, others: DataFrame, key: str, other: str) -> DataFrame:
    """The nearest other node of each node by sentence, then token distance, then id: ``(doc, key, other, dsent, dtok)``."""
    a = nodes.select("doc", key, F.col("sent").alias("s1"), F.col("tok").alias("k1"))
    b = others.select("doc", other, F.col("sent").alias("s2"), F.col("tok").alias("k2"))
    rows = a.join(b, "doc")
    d = F.struct(F.abs(F.col("s1") - F.col("s2")).alias("dsent"), F.abs(F.col("k1") - F.col("k2")).alias("dtok"), F.col(other).alias("other"))
    return rows.groupBy("doc", key).agg(F.min(d).alias("d")).select("doc", key, F.col("d.other").alias(other), "d.dsent", "d.dtok")


def event_timex_atoms(events: DataFrame, timexes: DataFrame) -> DataFrame:
    """``(doc, ev, tx, atom)`` of all pairs of a document's ``(doc, ev, type, sent, tok)`` and ``(doc, tx, timex_type, text, sent, tok)``.

    What one end decides, its nearest partner, shape and granularity, is found before the ends are paired.
    """
    near_tx = nearest(events, timexes, "ev", "tx").select("doc", "ev", F.col("tx").alias("near_tx"))
    near_ev = nearest(timexes, events, "tx", "ev").select("doc", "tx", F.col("ev").alias("near_ev"))
    first = timexes.groupBy("doc").agg(F.min(F.struct("sent", "tok", "tx")).alias("f")).select("doc", F.col("f.tx").alias("first_tx"))
    ev = events.join(near_tx, ["doc", "ev"], "left").select("doc", "ev", "type", F.col("sent").alias("sent_e"), F.col("tok").alias("tok_e"), "near_tx")
    own = {"gran": S.granularity(S.parse_date(F.col("text"))), "shape": S.surface_shape(F.col("text")), "first_date": F.col("first_tx") == F.col("tx")}
    tx = timexes.join(near_ev, ["doc", "tx"], "left").join(first, "doc", "left").withColumns(own)
    tx = tx.select("doc", "tx", "timex_type", F.col("sent").alias("sent_x"), F.col("tok").alias("tok_x"), "near_ev", *own)
    rows = ev.join(tx, "doc")
    atoms = {
        "etype": F.col("type"),
        "ttype": F.col("timex_type"),
        "anch": F.col("timex_type").isin(*V.ANCHORABLE),
        "gran": F.col("gran"),
        "shape": F.col("shape"),
        "sdist": S.short_bucket(F.abs(F.col("sent_e") - F.col("sent_x"))),
        "tdist": S.token_bucket(F.abs(F.col("tok_e") - F.col("tok_x"))),
        "order": F.when(F.struct("sent_e", "tok_e") < F.struct("sent_x", "tok_x"), "ev_first").otherwise("tx_first"),
        "nearest_tx": F.col("near_tx") == F.col("tx"),
        "nearest_ev": F.col("near_ev") == F.col("ev"),
        "first_date": F.col("first_date"),
    }
    return rows.select("doc", "ev", "tx", F.explode(F.array_compact(F.array(*[scalar_atom("EQ", k, v) for k, v in atoms.items()]))).alias("atom"))


def timex_pair_atoms(timexes: DataFrame) -> DataFrame:
    """``(doc, a, b, atom)`` of pairs a < b of a document's time expressions ``(doc, tx, timex_type, text, sent, tok)``; a text is read once."""
    read = timexes.select("doc", "tx", "timex_type", "sent", "tok", S.parse_date(F.col("text")).alias("date"))
    read = read.withColumn("gran", S.granularity(F.col("date")))
    side = lambda end: read.select("doc", F.col("tx").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("timex_type", "sent", "tok", "date", "gran")])
    rows = side("a").join(side("b"), "doc").where("a < b")
    atoms = {
        "ta": F.col("timex_type_a"),
        "tb": F.col("timex_type_b"),
        "ga": F.col("gran_a"),
        "gb": F.col("gran_b"),
        "cal": S.compare_dates(F.col("date_a"), F.col("date_b")),
        "order": F.when(F.struct("sent_a", "tok_a") < F.struct("sent_b", "tok_b"), "fwd").otherwise("rev"),
        "sdist": S.short_bucket(F.abs(F.col("sent_a") - F.col("sent_b"))),
    }
    return rows.select("doc", "a", "b", F.explode(F.array_compact(F.array(*[scalar_atom("EQ", k, v) for k, v in atoms.items()]))).alias("atom"))


#: The layer of each attribute.
LAYER_OF = {
    "type_a": "ONT", "type_b": "ONT", "same_type": "ONT", "roles_a": "ARG", "roles_b": "ARG", "role_overlap": "ARG", "role_subset": "ARG",
    "sdist": "DISC", "torder": "DISC", "bucket_a": "DISC", "bucket_b": "DISC", "sent_gap": "DISC", "a_before_b": "DISC", "mention_cmp": "LEX",
}


def layer_of(atom: Column) -> Column:
    attribute, out = F.get(F.split(atom, r"\|"), 1), None
    for layer in V.LAYERS:
        names = [k for k, v in LAYER_OF.items() if v == layer]
        if names:
            out = F.when(attribute.isin(*names), layer) if out is None else out.when(attribute.isin(*names), layer)
    return out.otherwise("TIME")


def container_lexicon(edges: DataFrame, words: DataFrame, prior_strength: float = 20.0, least_degree: int = 20) -> DataFrame:
    """``(word, degree, rate, bucket)``: how often a word's node is the container, smoothed towards the global rate.

    hi above twice the global rate, lo below half of it, else mid; words under ``least_degree`` ends are left out.
    """
    w = lambda end: words.select("doc", F.col("ev").alias(end), "word")
    contains = (F.col("rel") == "CONTAINS").cast("long")
    ends = edges.join(w("s"), ["doc", "s"]).select("word", contains.alias("as_container")).unionByName(edges.join(w("t"), ["doc", "t"]).select("word", F.lit(0).cast("long").alias("as_container")))
    total = ends.agg(F.sum("as_container") / F.count(F.lit(1))).first()[0] or 0.0
    per = ends.groupBy("word").agg(F.count(F.lit(1)).alias("degree"), F.sum("as_container").alias("c")).where(F.col("degree") >= least_degree)
    rate = (F.col("c") + prior_strength * total) / (F.col("degree") + prior_strength)
    return per.select("word", "degree", rate.alias("rate"), F.when(rate > 2 * total, "hi").when(rate < 0.5 * total, "lo").otherwise("mid").alias("bucket"))


def container_rates(edges: DataFrame, nodes: DataFrame, prior_strength: float = 20.0, least_degree: int = 20) -> DataFrame:
    """``(doc, ev, src, tgt, src_bucket, tgt_bucket)``: how often a node's word contains and is contained, smoothed.

    ``nodes`` is ``(doc, ev, word, type)``.  A word under ``least_degree`` ends backs off to its node's type, a node without
    either to the global rate.  hi is above twice the global rate, lo below half of it.
    """
    hit = (F.col("rel") == "CONTAINS").cast("long")
    end = lambda e, src, tgt: edges.select("doc", F.col(e).alias("ev"), src.alias("src"), tgt.alias("tgt"))
    no = F.lit(0).cast("long")
    ends = end("s", hit, no).unionByName(end("t", no, hit)).join(nodes, ["doc", "ev"])
    sums = [F.count(F.lit(1)).alias("n"), F.sum("src").alias("src"), F.sum("tgt").alias("tgt")]
    per_type = ends.groupBy("type").agg(F.struct(*sums).alias("by_type"))
    per_word = ends.groupBy("word").agg(F.struct(*sums).alias("by_word")).where(F.col("by_word.n") >= least_degree)
    whole = per_type.agg(F.sum("by_type.n").alias("n"), F.sum("by_type.src").alias("src"), F.sum("by_type.tgt").alias("tgt")).first()
    rows = nodes.join(per_word, "word", "left").join(per_type, "type", "left").withColumn("by", F.coalesce("by_word", "by_type"))
    out = rows.select("doc", "ev", "by")
    for c in ("src", "tgt"):
        mean = whole[c] / whole["n"] if whole["n"] else 0.0
        rate = (F.coalesce(F.col(f"by.{c}"), no) + prior_strength * mean) / (F.coalesce(F.col("by.n"), no) + prior_strength)
        out = out.withColumn(c, rate).withColumn(f"{c}_bucket", F.when(F.col(c) > 2 * mean, "hi").when(F.col(c) < 0.5 * mean, "lo").otherwise("mid"))
    return out.drop("by")


def container_atoms(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc, s, t, rel, atom)``: buckets of both ends' ``container_rates``, and which end contains more than twice as often."""
    rates = container_rates(edges, nodes)
    side = lambda e, x: rates.select("doc", F.col("ev").alias(e), *[F.col(c).alias(f"{c}_{x}") for c in ("src", "src_bucket", "tgt_bucket")])
    rows = edges.select("doc", "s", "t", "rel").join(side("s", "a"), ["doc", "s"]).join(side("t", "b"), ["doc", "t"])
    a, b = F.col("src_a"), F.col("src_b")
    atoms = {"src_a": F.col("src_bucket_a"), "src_b": F.col("src_bucket_b"), "tgt_a": F.col("tgt_bucket_a"), "tgt_b": F.col("tgt_bucket_b"), "src_cmp": F.when(a > 2 * b, "a>>b").when(b > 2 * a, "b>>a").otherwise("~")}
    return rows.select("doc", "s", "t", "rel", F.explode(F.array(*[scalar_atom("DUR", k, v) for k, v in atoms.items()])).alias("atom"))


def type_clusters(roles: DataFrame, k: int = 12, seed: int = 0) -> DataFrame:
    """``(type, cluster)``: event types by spherical k-means on their role frames ``(type, role, n)``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer, VectorAssembler

    names = [r["role"] for r in roles.select("role").distinct().orderBy("role").collect()]  # a closed set of roles
    wide = roles.groupBy("type").pivot("role", names).agg(F.sum("n")).na.fill(0.0)
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(wide)
    vectors = Normalizer(inputCol="raw", outputCol="features").transform(vectors)
    k = max(2, min(k, vectors.count()))
    model = KMeans(k=k, seed=seed, maxIter=50, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select("type", F.col("cluster").cast("long").alias("cluster"))


def views(features: DataFrame) -> DataFrame:
    """Each row once for each view with its class there: ``(..., view, sig)``."""
    sets = {
        "global": F.lit(""), "sdist": F.col("sdist"), "order": F.coalesce("torder", F.lit("none")), "bucket_a": F.col("bucket_a"), "etype_a": F.col("type_a"),
        "sdist_order": F.concat_ws("&", "sdist", F.coalesce("torder", F.lit("none"))),
    }
    return features.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("view"), v.alias("sig")) for k, v in sets.items()])).alias("v")).select(*features.columns, "v.view", "v.sig")


def base_rates(viewed: DataFrame, least_n: int = 25, least_k: int = 8) -> DataFrame:
    """``(view, sig, rel, n, k, p0)`` of the classes large enough to mine; rows with ``c`` count that often."""
    counts = viewed.groupBy("view", "sig", "rel").agg((F.sum("c") if "c" in viewed.columns else F.count(F.lit(1))).alias("k"))
    n = F.sum("k").over(W.partitionBy("view", "sig"))
    return counts.withColumn("n", n).where((F.col("n") >= least_n) & (F.col("k") >= least_k)).withColumn("p0", F.col("k") / F.col("n"))
