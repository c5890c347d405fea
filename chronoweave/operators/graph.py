"""Graph construction: nodes, edges, anchors and the pairs that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.functions import vocabulary as V


def event_nodes(mentions: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Clusters of mentions ``(doc, ev, sent, tok, word)``: size, distinct sentences, first mention and its word.

    The first mention has the smallest (sentence, token), words break ties.  With a profile, its columns are joined on and an
    event outside it has in_arg false.
    """
    first = F.min(F.struct("sent", "tok", "word"))
    nodes = mentions.groupBy("doc", "ev").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("sent").alias("sent_span"), first.alias("f"))
    nodes = nodes.select("doc", "ev", "n_mentions", "sent_span", F.col("f.sent").alias("sent_first"), F.col("f.tok").alias("tok_first"), F.col("f.word").alias("trigger"), S.sentence_bucket(F.col("f.sent")).alias("sent_bucket"))
    if profile is None:
        return nodes
    extra = [c for c in profile.columns if c not in ("doc", "ev")]
    return nodes.join(profile.withColumn("in_arg", F.lit(True)), ["doc", "ev"], "left").select(*nodes.columns, F.coalesce("in_arg", F.lit(False)).alias("in_arg"), *extra)


def argument_profile(arguments: DataFrame) -> DataFrame:
    """Of ``(doc, ev, role, etype, filler)``: roles, entity types, counts and flags of each event; etype is null for spans."""
    has = lambda kind: F.coalesce(F.bool_or(F.col("etype") == kind), F.lit(False))
    return arguments.groupBy("doc", "ev").agg(
        F.count_distinct("role").alias("n_role"),
        F.array_sort(F.collect_set("role")).alias("roleset"),
        F.array_sort(F.collect_set("etype")).alias("etypeset"),
        has("0").alias("has_person"),
        has("1").alias("has_org"),
        has("2").alias("has_loc"),
        F.count_if(~F.col("filler")).alias("n_entity_arg"),
        F.count_if(F.col("filler")).alias("n_span_arg"),
    )


def timex_nodes(timexes: DataFrame) -> DataFrame:
    return timexes.select("doc", "tx", "timex_type", F.col("timex_type").isin(*V.ANCHORABLE).alias("anchorable"), "text", F.col("sent").alias("sent_first"), F.col("tok").alias("tok_first"))


def argument_edges(arguments: DataFrame, events: DataFrame) -> DataFrame:
    """``(doc, s, anchor, role, strength)`` of fillers with an entity id or a span, of known events, each once."""
    anchor = F.when(F.col("filler"), F.col("span")).otherwise(F.concat(F.lit("ENT_"), F.col("supplier").cast("string")))
    rows = arguments.select("doc", "ev", anchor.alias("anchor"), "role", F.when(F.col("filler"), "span").otherwise("entity").alias("strength"))
    rows = rows.where("anchor is not null").join(events.select("doc", "ev").distinct(), ["doc", "ev"], "left_semi")
    return rows.withColumnRenamed("ev", "s").dropDuplicates()


def entity_nodes(edges: DataFrame, declared: DataFrame, most: int = 5) -> DataFrame:
    """``(doc, anchor, etype, stub, n_mentions, mentions)``: entities that edges use; those not declared are stubs.

    ``declared`` is ``(anchor, etype)``; the mentions listed are the first roles under which an entity appears.
    """
    used = edges.where("strength = 'entity'").groupBy("doc", "anchor").agg(F.count(F.lit(1)).alias("n_mentions"), F.array_join(F.slice(F.array_sort(F.collect_set("role")), 1, most), ",").alias("mentions"))
    return used.join(declared, "anchor", "left").select("doc", "anchor", "etype", F.col("etype").isNull().alias("stub"), "n_mentions", "mentions")


def relation_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Temporal edges: without dangling ends and loops; symmetric labels from the smaller to the larger id, each once."""
    known = nodes.select("doc", F.col("ev").alias("n")).distinct()
    rows = raw.where("s <> t")
    for end in ("s", "t"):
        rows = rows.join(known.withColumnRenamed("n", end), ["doc", end], "left_semi")
    symmetric = S.is_symmetric(F.col("rel"))
    once = rows.where(symmetric).select("doc", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), "rel").dropDuplicates()
    return rows.where(~symmetric).select("doc", "s", "t", "rel").unionByName(once)


def weak_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Causal and part-of edges without dangling ends; loops stay."""
    known = nodes.select("doc", F.col("ev").alias("n")).distinct()
    for end in ("s", "t"):
        raw = raw.join(known.withColumnRenamed("n", end), ["doc", end], "left_semi")
    return raw.select("doc", "s", "t", "kind")


def anchor_index(edges: DataFrame) -> DataFrame:
    """Anchors that connect two or more events of a document."""
    return edges.groupBy("doc", "anchor").agg(F.count_distinct("s").alias("n_events")).where("n_events >= 2")


def anchored_pairs(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """``(doc, a, b, n_anchors, anchors, roles, strength, sdist, torder)`` of event pairs a < b that share an anchor.

    ``roles`` lists every pair of roles under which they share one, repeats kept; strength is entity, span or mixed;
    ``positions`` is ``(doc, ev, sent, tok)``.
    """
    shared = edges.join(anchor_index(edges).select("doc", "anchor"), ["doc", "anchor"], "left_semi")
    a = shared.select("doc", "anchor", "strength", F.col("s").alias("a"), F.col("role").alias("ra"))
    b = shared.select("doc", "anchor", F.col("s").alias("b"), F.col("role").alias("rb"))
    pairs = a.join(b, ["doc", "anchor"]).where("a < b").groupBy("doc", "a", "b").agg(
        F.count_distinct("anchor").alias("n_anchors"),
        F.array_join(F.array_sort(F.collect_set("anchor")), ",").alias("anchors"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "ra", "rb"))), ",").alias("roles"),
        F.when(F.min("strength") == F.max("strength"), F.min("strength")).otherwise("mixed").alias("strength"),
    )
    at = lambda end: positions.select("doc", F.col("ev").alias(end), F.col("sent").alias(f"sent_{end}"), F.col("tok").alias(f"tok_{end}"))
    rows = pairs.join(at("a"), ["doc", "a"], "left").join(at("b"), ["doc", "b"], "left")
    order = F.when(F.struct("sent_a", "tok_a") < F.struct("sent_b", "tok_b"), "fwd").when(F.struct("sent_a", "tok_a") > F.struct("sent_b", "tok_b"), "rev")
    return rows.select("doc", "a", "b", "n_anchors", "anchors", "roles", "strength", F.abs(F.col("sent_a") - F.col("sent_b")).alias("sdist"), order.alias("torder"))


def census(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(item, kind, n)``: rows of each table by a column."""
    parts = [df.groupBy(F.col(column).cast("string").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "kind", "n") for name, (df, column) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
