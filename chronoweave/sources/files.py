"""Readers of event documents, argument archives, manifests, predictions, rules and features, and the writers beside them."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.sources import schemas


def read_event_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of event documents; blank lines are skipped."""
    return spark.read.schema(schemas.EVENT_DOCUMENT).json(path)


def read_argument_archive(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Argument documents of a JSON-lines member of ZIP archives; the last document of an id wins."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as lines:
                    rows = []
                    for i, line in enumerate(io.TextIOWrapper(lines, "utf-8")):
                        if line.strip():
                            rows.append((name, i, line))
                        if len(rows) == 2_000:
                            yield pd.DataFrame(rows, columns=["file", "line", "value"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["file", "line", "value"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "file string, line long, value string")
    parsed = raw.select("file", "line", F.from_json("value", schemas.ARGUMENT_DOCUMENT).alias("d"))
    return parsed.groupBy("d.id").agg(F.max_by("d", F.struct("file", "line")).alias("d")).select("d.*")


def subevent_pairs(raw: Column) -> Column:
    """``array<array<string>>`` of a field that is a list of pairs or a map of such lists."""
    pairs = "array<array<string>>"
    return F.coalesce(F.from_json(raw, pairs), F.flatten(F.map_values(F.from_json(raw, f"map<string,{pairs}>"))), F.array().cast(pairs))


def nodes_of(docs: DataFrame) -> DataFrame:
    """``(doc, id, type, type_id, mention)``: the event clusters of event documents."""
    return docs.select(F.col("id").alias("doc"), F.explode("events").alias("e")).select("doc", "e.*")


def relations_of(docs: DataFrame, column: str = "temporal_relations") -> DataFrame:
    """``(doc, s, t, rel)`` of a map from relation to pairs."""
    rows = docs.select(F.col("id").alias("doc"), F.explode(column).alias("rel", "pairs"))
    return rows.select("doc", "rel", F.explode("pairs").alias("p")).select("doc", F.get("p", 0).alias("s"), F.get("p", 1).alias("t"), "rel")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(rate, doc, s, t, fake)`` of a noise manifest, which is one JSON object."""
    rows = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return rows.select("rate", F.explode("changed").alias("c")).select("rate", "c.doc", F.col("c.event1").alias("s"), F.col("c.event2").alias("t"), "c.fake")


def reconcile_manifest(edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """``edges(doc, s, t, rel)`` with ``observed`` and ``how``: used as written, used reversed (symmetric labels only), or clean."""
    m = manifest.select("doc", "s", "t", "fake")
    back = m.select("doc", F.col("t").alias("s"), F.col("s").alias("t"), F.col("fake").alias("fake_back"))
    joined = edges.join(m, ["doc", "s", "t"], "left").join(back, ["doc", "s", "t"], "left")
    reversed_ok = F.col("fake").isNull() & F.col("fake_back").isNotNull() & S.is_symmetric(F.col("fake_back"))
    how = F.when(F.col("fake").isNotNull(), "used").when(reversed_ok, "reversed").when(F.col("fake_back").isNotNull(), "skipped").otherwise("clean")
    observed = F.when(how == "used", F.col("fake")).when(how == "reversed", F.col("fake_back")).otherwise(F.col("rel"))
    return joined.select(*edges.columns, observed.alias("observed"), how.alias("how"))


def read_predictions(spark: SparkSession, path: str, docs: DataFrame | None = None) -> DataFrame:
    """``(doc, s, t, pred)`` from Parquet, for the documents of ``docs`` if given."""
    preds = spark.read.parquet(path)
    return preds if docs is None else preds.join(docs.select("doc").distinct(), "doc", "left_semi")


def parse_prediction_map(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(doc, s, t, pred)`` of JSON objects that map ``doc|s|t`` to a label."""
    rows = lines.select(F.explode(F.from_json(value, "map<string,string>")).alias("key", "pred"))
    part = F.split("key", r"\|")
    return rows.select(F.get(part, 0).alias("doc"), F.get(part, 1).alias("s"), F.get(part, 2).alias("t"), "pred")


def merge_predictions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Predictions by key, the newer where both have one."""
    n = new.select("doc", "s", "t", F.col("pred").alias("new_pred"))
    return old.join(n, ["doc", "s", "t"], "full").select("doc", "s", "t", F.coalesce("new_pred", "pred").alias("pred"))


def parse_rules(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rules ``(rule_id, view, sig, rel, n_conds, w)`` and their conditions ``(rule_id, cond)`` from a JSON array.

    A missing view is ``global`` and its signature empty.  Rules are numbered from zero as they stand.
    """
    rows = raw.select(F.posexplode(F.from_json(value, schemas.RULES)).alias("rule_id", "r")).withColumn("rule_id", F.col("rule_id").cast("long"))
    rules = rows.select("rule_id", F.coalesce("r.view", F.lit("global")).alias("view"), F.coalesce("r.sig", F.lit("")).alias("sig"), "r.rel", F.size("r.conds").cast("long").alias("n_conds"), F.col("r.wlb").alias("w"))
    return rules, rows.select("rule_id", F.explode("r.conds").alias("cond"))


def rules_to_json(rules: DataFrame, conds: DataFrame) -> DataFrame:
    """One row: the rule library as a JSON array in the order of rule_id."""
    whole = rules.join(conds.groupBy("rule_id").agg(F.array_sort(F.collect_list("cond")).alias("conds")), "rule_id")
    listed = F.array_sort(F.collect_list(F.struct("rule_id", "view", "sig", "rel", "conds", F.col("w").alias("wlb"))))
    return whole.agg(F.to_json(listed).alias("value"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated feature rows, compressed or not; atoms are split at the bar."""
    rows = spark.read.schema(schemas.FEATURES).csv(path, sep="\t", header=True)
    return rows.withColumn("atoms", F.filter(F.split("atoms", r"\|"), lambda a: a != ""))


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """The normalised tables of a graph, a Parquet folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def graph_to_jsonl(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line for each document: its nodes and its edges, each sorted."""
    n = nodes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*[c for c in nodes.columns if c != "doc"]))).alias("nodes"))
    e = edges.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*[c for c in edges.columns if c != "doc"]))).alias("target_edges"))
    return n.join(e, "doc", "left").select(F.to_json(F.struct("doc", "nodes", "target_edges")).alias("value"))


def rule_listing(rules: DataFrame, conds: DataFrame) -> DataFrame:
    """``(rel, template, n_rules, listing)``: rules by label and by the attributes that they test, as text."""
    attribute = F.concat_ws("|", F.get(F.split("cond", r"\|"), 0), F.get(F.split("cond", r"\|"), 1))
    per_rule = conds.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list(attribute)), " & ").alias("template"), F.array_join(F.array_sort(F.collect_list("cond")), " & ").alias("body"))
    rows = rules.join(per_rule, "rule_id")
    return rows.groupBy("rel", "template").agg(F.count(F.lit(1)).alias("n_rules"), F.array_join(F.array_sort(F.collect_list(F.concat("body", F.lit(" => "), "rel"))), "; ").alias("listing"))


def head(docs: DataFrame, n: int, order: str = "doc") -> DataFrame:
    """The first ``n`` documents in a fixed order."""
    return docs.orderBy(order).limit(n)


def closest_mentions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Of two nodes' mentions ``(keys..., sent, tok)`` the pair with the least sentence, then token distance."""
    pairs = a.select(*keys, F.col("sent").alias("sa"), F.col("tok").alias("ta")).join(b.select(*keys, F.col("sent").alias("sb"), F.col("tok").alias("tb")), keys)
    order = F.struct(F.abs(F.col("sa") - F.col("sb")), F.abs(F.col("ta") - F.col("tb")), "sa", "ta", "sb", "tb")
    return pairs.groupBy(*keys).agg(F.min_by(F.struct("sa", "ta", "sb", "tb"), order).alias("m")).select(*keys, "m.*")


def render_pair(tokens: Column, at_a: Column, at_b: Column) -> Column:
    """A sentence with its two nodes marked."""
    return F.array_join(F.transform(tokens, lambda w, i: F.when(i == at_a, F.concat(F.lit("[A:"), w, F.lit("]"))).when(i == at_b, F.concat(F.lit("[B:"), w, F.lit("]"))).otherwise(w)), " ")


def stats_json(stats: dict) -> str:
    return json.dumps(stats, sort_keys=True)
