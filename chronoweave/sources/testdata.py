"""The driver tables as an event graph: a customer is a document, an order with lines an event.

An event lasts from its order's date for as many days as its lines' quantities come to.  Suppliers are entities that lines
connect events to; every fourth line number gives a raw value instead, a span.  Years and months of a document's order dates
are its time expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, ev, sent, tok, word, role, supplier, filler, span)``: a row for each line of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key = F.md5(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string")).cast("binary"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("long").alias("doc"),
        F.col("l_orderkey").cast("long").alias("ev"),
        (F.col("l_partkey") % 12).cast("long").alias("sent"),
        F.col("l_partkey").cast("long").alias("tok"),
        F.date_format("l_shipdate", "EEEE").alias("word"),
        F.concat("l_returnflag", "l_linestatus").alias("role"),
        F.col("l_suppkey").cast("long").alias("supplier"),
        (F.col("l_linenumber") % 4 == 0).alias("filler"),
        F.concat(F.lit("SPAN_"), F.substring(key, 1, 16)).alias("span"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, ev, type, s, e, n_mentions, sent, tok)``."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n_mentions"))
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("long").alias("doc"),
        F.col("o_orderkey").cast("long").alias("ev"),
        F.col("o_orderpriority").alias("type"),
        start.alias("s"),
        F.date_add(start, F.ceil("q").cast("int")).alias("e"),
        "n_mentions",
        (F.col("o_orderkey") % 12).cast("long").alias("sent"),
        F.col("o_orderkey").cast("long").alias("tok"),
    )


def label(s1, e1, s2, e2):
    """Label of an interval pair whose first interval starts no later; null for the one relation without a label."""
    return (
        F.when(e1 < s2, "BEFORE")
        .when(e1 == s2, "ENDS-ON")
        .when((s1 == s2) & (e1 == e2), "SIMULTANEOUS")
        .when(s1 == s2, "BEGINS-ON")
        .when((s1 < s2) & (e2 < e1), "CONTAINS")
        .when((s1 < s2) & (s2 < e1) & (e1 < e2), "OVERLAP")
    )


def event_pairs(spark: SparkSession, sf_dir: str, more: DataFrame | None = None) -> DataFrame:
    """``(doc, s, t, rel, <a: and b: columns of the events>)``: labelled pairs, the earlier start first, then the smaller id.

    Columns of ``more``, ``(doc, ev, ...)``, join the events before they are paired.
    """
    ev = events(spark, sf_dir)
    ev = ev if more is None else ev.join(more, ["doc", "ev"], "left")
    a = ev.select("doc", *[F.col(c).alias(f"{c}_a") for c in ev.columns if c != "doc"])
    b = ev.select("doc", *[F.col(c).alias(f"{c}_b") for c in ev.columns if c != "doc"])
    first = (F.col("s_a") < F.col("s_b")) | ((F.col("s_a") == F.col("s_b")) & (F.col("ev_a") < F.col("ev_b")))
    rows = a.join(b, "doc").where(first).withColumn("rel", label(F.col("s_a"), F.col("e_a"), F.col("s_b"), F.col("e_b")))
    return rows.where("rel is not null").withColumnsRenamed({"ev_a": "s", "ev_b": "t"})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, s, t, rel)`` of ``event_pairs``."""
    return event_pairs(spark, sf_dir).select("doc", "s", "t", "rel")


def timexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, tx, timex_type, text, s, e, sent, tok)``: years and months of a document's dates."""
    dates = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("doc"), F.col("o_orderdate").cast("date").alias("d")).distinct()
    month = dates.select("doc", F.trunc("d", "month").alias("s")).distinct().select("doc", F.date_format("s", "yyyy-MM").alias("tx"), F.lit("DATE").alias("timex_type"), F.date_format("s", "MMMM yyyy").alias("text"), "s", F.last_day("s").alias("e"))
    year = dates.select("doc", F.trunc("d", "year").alias("s")).distinct().select("doc", F.date_format("s", "yyyy").alias("tx"), F.lit("DURATION").alias("timex_type"), F.date_format("s", "yyyy").alias("text"), "s", F.date_sub(F.add_months("s", 12), 1).alias("e"))
    both = month.unionByName(year)
    return both.withColumn("sent", (F.year("s") + F.month("s") * F.length("tx")).cast("long") % 12).withColumn("tok", (F.year("s") * 100 + F.month("s") * F.length("tx")).cast("long"))


def mixed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, s, t, kind, rel)``: labelled pairs of events and of years (nodes below zero), all four kinds of edges.

    Events are paired with each other, years with each other, and an event with the years that it touches.
    """
    years = timexes(spark, sf_dir).where("timex_type = 'DURATION'")
    nodes = events(spark, sf_dir).select("doc", F.col("ev").alias("n"), F.lit("E").alias("k"), "s", "e").unionByName(years.select("doc", (-F.col("tx").cast("long")).alias("n"), F.lit("T").alias("k"), "s", "e"))
    a, b = (nodes.select("doc", *[F.col(c).alias(f"{c}_{x}") for c in "nkse"]) for x in "ab")
    c = F.col
    first = (c("s_a") < c("s_b")) | ((c("s_a") == c("s_b")) & (c("n_a") < c("n_b")))
    touch = (c("k_a") == c("k_b")) | ((c("s_a") <= c("e_b")) & (c("s_b") <= c("e_a")))
    rows = a.join(b, "doc").where(first & touch)
    return rows.select("doc", c("n_a").alias("s"), c("n_b").alias("t"), F.concat("k_a", "k_b").alias("kind"), label(c("s_a"), c("e_a"), c("s_b"), c("e_b")).alias("rel")).where("rel is not null")


# DuckDB text of the same views, from which the oracle queries are put together.
SQL_MENTIONS = """mn as (select cast(o_custkey as bigint) doc, cast(l_orderkey as bigint) ev, cast(l_partkey % 12 as bigint) sent, cast(l_partkey as bigint) tok, strftime(l_shipdate, '%A') word,
  l_returnflag || l_linestatus as role, cast(l_suppkey as bigint) supplier, l_linenumber % 4 = 0 filler,
  'SPAN_' || substr(md5(cast(l_partkey as varchar) || ':' || cast(cast(l_quantity as bigint) as varchar)), 1, 16) span
  from lineitem join orders on l_orderkey = o_orderkey)"""
SQL_EVENTS = """ev as (select cast(o_custkey as bigint) doc, cast(o_orderkey as bigint) ev, o_orderpriority as type, cast(o_orderdate as date) s,
  cast(o_orderdate as date) + cast(ceil(q) as integer) e, n_mentions, cast(o_orderkey % 12 as bigint) sent, cast(o_orderkey as bigint) tok
  from orders join (select l_orderkey, sum(l_quantity) q, count(*) n_mentions from lineitem group by 1) l on l_orderkey = o_orderkey)"""
SQL_PAIRS = f"""{SQL_EVENTS}, pr as (select * from (select a.doc, a.ev s, b.ev t, a.type type_a, b.type type_b, a.n_mentions n_mentions_a, b.n_mentions n_mentions_b,
  a.sent sent_a, b.sent sent_b, a.tok tok_a, b.tok tok_b, a.s s_a, a.e e_a, b.s s_b, b.e e_b,
  case when a.e < b.s then 'BEFORE' when a.e = b.s then 'ENDS-ON' when a.s = b.s and a.e = b.e then 'SIMULTANEOUS' when a.s = b.s then 'BEGINS-ON'
  when a.s < b.s and b.e < a.e then 'CONTAINS' when a.s < b.s and b.s < a.e and a.e < b.e then 'OVERLAP' end rel
  from ev a join ev b on a.doc = b.doc and (a.s < b.s or (a.s = b.s and a.ev < b.ev))) where rel is not null)"""
SQL_TIMEX = """tm as (select *, cast((year(s) + month(s) * length(tx)) % 12 as bigint) sent, cast(year(s) * 100 + month(s) * length(tx) as bigint) tok from (
  select distinct cast(o_custkey as bigint) doc, strftime(o_orderdate, '%Y-%m') tx, 'DATE' timex_type, strftime(o_orderdate, '%B %Y') as text,
  cast(date_trunc('month', o_orderdate) as date) s, cast(last_day(o_orderdate) as date) e from orders
  union all select distinct cast(o_custkey as bigint), strftime(o_orderdate, '%Y'), 'DURATION', strftime(o_orderdate, '%Y'),
  cast(date_trunc('year', o_orderdate) as date), cast(date_trunc('year', o_orderdate) + interval 1 year - interval 1 day as date) from orders))"""
_SQL_LABEL = """case when a.e < b.s then 'BEFORE' when a.e = b.s then 'ENDS-ON' when a.s = b.s and a.e = b.e then 'SIMULTANEOUS' when a.s = b.s then 'BEGINS-ON'
  when a.s < b.s and b.e < a.e then 'CONTAINS' when a.s < b.s and b.s < a.e and a.e < b.e then 'OVERLAP' end"""
SQL_MIXED = f"""{SQL_EVENTS}, yr as (select distinct cast(o_custkey as bigint) doc, year(o_orderdate) y from orders),
  nd as (select doc, ev n, 'E' k, s, e from ev union all select doc, cast(-y as bigint), 'T', make_date(y, 1, 1), make_date(y, 12, 31) from yr),
  pr as (select * from (select a.doc, a.n s, b.n t, a.k || b.k kind, {_SQL_LABEL} rel from nd a join nd b on a.doc = b.doc and (a.s < b.s or (a.s = b.s and a.n < b.n)) and (a.k = b.k or (a.s <= b.e and b.s <= a.e))) where rel is not null)"""
