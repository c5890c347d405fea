"""Sources, graph construction and invariant checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.operators import graph as G
from chronoweave.operators import verify as VF
from chronoweave.plans.base import query
from chronoweave.sources import files
from chronoweave.sources import testdata as T

M, E, P, X = T.SQL_MENTIONS, T.SQL_EVENTS, T.SQL_PAIRS, T.SQL_TIMEX
SYM = "('SIMULTANEOUS', 'BEGINS-ON')"

# The argument layer: a line connects its event to a supplier, whose type is its region, or to a raw value.
SQL_ARG = f"""{M}, ag as (select mn.*, case when filler then null else cast(n_regionkey as varchar) end etype from mn
  left join supplier on s_suppkey = supplier left join nation on n_nationkey = s_nationkey)"""
SQL_HAS_ARG = f"""{SQL_ARG}, he as (select distinct doc, ev s, case when filler then span else 'ENT_' || supplier end anchor, role, case when filler then 'span' else 'entity' end strength from ag)"""
SQL_WEAK_RAW = """wr as (select cast(o_custkey as bigint) doc, cast(o_orderkey as bigint) s, cast(case when o_orderkey % 7 = 0 then o_orderkey
  else coalesce(lead(o_orderkey) over (partition by o_custkey order by o_orderkey), -1) end as bigint) t,
  case o_orderkey % 3 when 0 then 'CAUSE' when 1 then 'PRECONDITION' else 'SUBEVENT' end kind from orders)"""
SQL_WEAK = f"""{E}, {SQL_WEAK_RAW}, we as (select wr.* from wr where exists (select 1 from ev where ev.doc = wr.doc and ev.ev = wr.s) and exists (select 1 from ev where ev.doc = wr.doc and ev.ev = wr.t))"""
# Edges with planted defects, for the checks.
SQL_DIRTY = f"""{P}, dt as (
  select doc, case when (s + t) % 97 = 0 then t else s end s, case when (s + 2 * t) % 89 = 0 then -t else t end t, rel from pr
  union all select doc, t, s, rel from pr where rel in {SYM}
  union all select doc, s, t, 'OVERLAP' from pr where rel = 'BEFORE' and (s * 3 + t) % 83 = 0
  union all select doc, t, s, 'CONTAINS' from pr where (s * 5 + t) % 181 = 0)"""


def arguments(spark, sf):
    types = T.table(spark, sf, "supplier").join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("long").alias("supplier"), F.col("n_regionkey").cast("string").alias("region"))
    return T.mentions(spark, sf).join(types, "supplier", "left").withColumn("etype", F.when(~F.col("filler"), F.col("region"))).drop("region")


def has_arg(spark, sf):
    return G.argument_edges(arguments(spark, sf), T.events(spark, sf))


def weak_raw(spark, sf):
    from pyspark.sql import Window as W

    o = T.table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("doc"), F.col("o_orderkey").cast("long").alias("s"))
    following = F.lead("s").over(W.partitionBy("doc").orderBy("s"))
    kind = F.when(F.col("s") % 3 == 0, "CAUSE").when(F.col("s") % 3 == 1, "PRECONDITION").otherwise("SUBEVENT")
    return o.select("doc", "s", F.when(F.col("s") % 7 == 0, F.col("s")).otherwise(F.coalesce(following, F.lit(-1))).alias("t"), kind.alias("kind"))


def dirty(spark, sf):
    e = T.edges(spark, sf)
    s, t = F.col("s"), F.col("t")
    out = e.select("doc", F.when((s + t) % 97 == 0, t).otherwise(s).alias("s"), F.when((s + 2 * t) % 89 == 0, -t).otherwise(t).alias("t"), "rel")
    back = lambda df, rel: df.select("doc", t.alias("s"), s.alias("t"), rel)
    out = out.unionByName(back(e.where(S.is_symmetric(F.col("rel"))), F.col("rel")))
    out = out.unionByName(e.where((F.col("rel") == "BEFORE") & ((s * 3 + t) % 83 == 0)).select("doc", "s", "t", F.lit("OVERLAP").alias("rel")))
    return out.unionByName(back(e.where((s * 5 + t) % 181 == 0), F.lit("CONTAINS").alias("rel")))


# ------------------------------------------------------------------- sources


@query(f"with {E} select doc, ev, type, n_mentions from ev")
def src_event_documents(spark, sf):
    """Event documents as JSON lines, parsed by their declared schema and taken apart again."""
    ev = T.events(spark, sf).select("doc", "ev", "type", "n_mentions")
    mention = F.transform(F.sequence(F.lit(1), F.col("n_mentions")), lambda i: F.struct(i.cast("string").alias("id"), F.lit("w").alias("trigger_word"), F.lit(0).alias("sent_id"), F.array(F.lit(0)).alias("offset")))
    lines = ev.groupBy("doc").agg(F.collect_list(F.struct(F.col("ev").cast("string").alias("id"), "type", F.lit(0).alias("type_id"), mention.alias("mention"))).alias("events")).select(F.to_json(F.struct(F.col("doc").cast("string").alias("id"), "events")).alias("value"))
    from chronoweave.sources import schemas

    docs = lines.select(F.from_json("value", schemas.EVENT_DOCUMENT).alias("d")).select("d.*")
    return files.nodes_of(docs).select(F.col("doc").cast("long").alias("doc"), F.col("id").cast("long").alias("ev"), "type", F.size("mention").cast("long").alias("n_mentions"))


@query(f"""with {P}, {SQL_HAS_ARG}, {SQL_WEAK_RAW},
  h2 as (select * from he where (doc, anchor) in (select (doc, anchor) from he group by doc, anchor having count(distinct s) >= 2)),
  ap as (select a.doc, a.s a, b.s b, count(distinct a.anchor) n_anchors, case when min(a.strength) = max(a.strength) then min(a.strength) else 'mixed' end strength
    from h2 a join h2 b on a.doc = b.doc and a.anchor = b.anchor and a.s < b.s group by all),
  wk as (select doc, s, t, min(kind) kind from wr group by all)
  select pr.doc, pr.s, pr.t, rel, type_a, type_b, coalesce(n_anchors, 0) n_anchors, coalesce(strength, 'none') strength,
    case when w1.kind is not null then 'ab' when w2.kind is not null then 'ba' else 'none' end weak
  from pr left join ap on ap.doc = pr.doc and ap.a = least(pr.s, pr.t) and ap.b = greatest(pr.s, pr.t)
  left join wk w1 on w1.doc = pr.doc and w1.s = pr.s and w1.t = pr.t left join wk w2 on w2.doc = pr.doc and w2.s = pr.t and w2.t = pr.s""")
def src_instances(spark, sf):
    """Event pairs with their label, what they share and their weak edges, found in either direction."""
    pairs = T.event_pairs(spark, sf).select("doc", "s", "t", "rel", "type_a", "type_b")
    anchored = G.anchored_pairs(has_arg(spark, sf), T.events(spark, sf)).select("doc", "a", "b", "n_anchors", "strength")
    weak = weak_raw(spark, sf).groupBy("doc", "s", "t").agg(F.min("kind").alias("ab"))
    back = weak.select("doc", F.col("t").alias("s"), F.col("s").alias("t"), F.col("ab").alias("ba"))
    keyed = pairs.withColumns({"a": F.least("s", "t"), "b": F.greatest("s", "t")}).join(anchored, ["doc", "a", "b"], "left")
    rows = keyed.join(weak, ["doc", "s", "t"], "left").join(back, ["doc", "s", "t"], "left")
    mark = F.when(F.col("ab").isNotNull(), "ab").when(F.col("ba").isNotNull(), "ba").otherwise("none")
    return rows.select("doc", "s", "t", "rel", "type_a", "type_b", F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"), F.coalesce("strength", F.lit("none")).alias("strength"), mark.alias("weak"))


_RULES = """[{"view":"sdist","sig":"0","rel":"CONTAINS","conds":["EQ|type_a|1-URGENT","REL|same_type|true"],"wlb":0.31},{"rel":"OVERLAP","conds":["EQ|type_b|5-LOW"],"wlb":0.22},{"view":"order","sig":"fwd","rel":"BEFORE","conds":["HAS|role_a|RF"],"wlb":0.9}]"""


@query("""select * from (values (0::bigint, 'sdist', '0', 'CONTAINS', 2::bigint, 0.31::double, 'EQ|type_a|1-URGENT'), (0, 'sdist', '0', 'CONTAINS', 2, 0.31, 'REL|same_type|true'),
  (1, 'global', '', 'OVERLAP', 1, 0.22, 'EQ|type_b|5-LOW'), (2, 'order', 'fwd', 'BEFORE', 1, 0.9, 'HAS|role_a|RF')) v(rule_id, "view", sig, rel, n_conds, w, cond)""")
def src_rules(spark, sf):
    rules, conds = files.parse_rules(spark.createDataFrame([(_RULES,)], "value string"))
    return rules.join(conds, "rule_id")


@query(f"with {P} select rel, count(*) n, count(distinct doc) docs from pr where doc in (select c_custkey from customer where c_nationkey = 7) group by rel")
def src_predictions_of_docs(spark, sf):
    keep = T.table(spark, sf, "customer").where("c_nationkey = 7").select(F.col("c_custkey").cast("long").alias("doc"))
    return T.edges(spark, sf).join(keep, "doc", "left_semi").groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"))


@query(f"""with {P}, mf as (select doc, case when t % 2 = 0 then s else t end s, case when t % 2 = 0 then t else s end t, case when (s + t) % 3 = 0 then 'BEGINS-ON' else 'OVERLAP' end fake from pr where (s * 7 + t) % 11 = 0)
  select how, observed, count(*) n from (select case when m.fake is not null then 'used' when b.fake is null then 'clean' when b.fake in {SYM} then 'reversed' else 'skipped' end how,
    case when m.fake is not null then m.fake when b.fake in {SYM} then b.fake else rel end observed
    from pr left join mf m using (doc, s, t) left join mf b on b.doc = pr.doc and b.s = pr.t and b.t = pr.s) group by all""")
def src_noise_manifest(spark, sf):
    e = T.edges(spark, sf)
    s, t = F.col("s"), F.col("t")
    hit = e.where((s * 7 + t) % 11 == 0)
    manifest = hit.select("doc", F.when(t % 2 == 0, s).otherwise(t).alias("s"), F.when(t % 2 == 0, t).otherwise(s).alias("t"), F.when((s + t) % 3 == 0, "BEGINS-ON").otherwise("OVERLAP").alias("fake"))
    return files.reconcile_manifest(e, manifest).groupBy("how", "observed").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {P}, o as (select doc, s, t, rel pred from pr where s % 3 <> 0), n as (select doc, s, t, 'OVERLAP' pred from pr where t % 4 = 0) select doc, s, t, coalesce(n.pred, o.pred) pred from o full join n using (doc, s, t)")
def snk_merge_predictions(spark, sf):
    e = T.edges(spark, sf)
    old = e.where("s % 3 <> 0").select("doc", "s", "t", F.col("rel").alias("pred"))
    return files.merge_predictions(old, e.where("t % 4 = 0").select("doc", "s", "t", F.lit("OVERLAP").alias("pred")))


@query("select * from (values ('BEFORE', 'HAS|role_a', 1::bigint, 'HAS|role_a|RF => BEFORE'), ('CONTAINS', 'EQ|type_a & REL|same_type', 1, 'EQ|type_a|1-URGENT & REL|same_type|true => CONTAINS'), ('OVERLAP', 'EQ|type_b', 1, 'EQ|type_b|5-LOW => OVERLAP')) v(rel, \"template\", n_rules, listing)")
def snk_rule_listing(spark, sf):
    rules, conds = files.parse_rules(spark.createDataFrame([(_RULES,)], "value string"))
    return files.rule_listing(rules, conds)


@query(f"""with {M}, m as (select distinct doc, ev, sent, tok from mn),
  p as (select a.doc, a.ev a, b.ev b, a.sent sa, a.tok ta, b.sent sb, b.tok tb, row_number() over (partition by a.doc, a.ev, b.ev order by abs(a.sent - b.sent), abs(a.tok - b.tok), a.sent, a.tok, b.sent, b.tok) r
    from m a join m b on a.doc = b.doc and a.ev < b.ev) select doc, a, b, sa, ta, sb, tb from p where r = 1""")
def snk_closest_mentions(spark, sf):
    """The mention pair by which an instance is shown."""
    m = T.mentions(spark, sf).groupBy("doc", "ev").agg(F.collect_set(F.struct("sent", "tok")).alias("m"))
    a, b = (m.select("doc", F.col("ev").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")

    def way(x, y):
        return F.struct(F.abs(x["sent"] - y["sent"]).alias("dsent"), F.abs(x["tok"] - y["tok"]).alias("dtok"), x["sent"].alias("sa"), x["tok"].alias("ta"), y["sent"].alias("sb"), y["tok"].alias("tb"))

    # the ways from one event's mentions to another's are compared inside the pair's row
    least = F.array_min(F.transform("ma", lambda x: F.array_min(F.transform("mb", lambda y: way(x, y)))))
    return a.join(b, "doc").where("a < b").withColumn("w", least).select("doc", "a", "b", "w.sa", "w.ta", "w.sb", "w.tb")


# ------------------------------------------------------------------ building


@query(f"""with {SQL_ARG}, f as (select doc, ev, sent, tok, word, row_number() over (partition by doc, ev order by sent, tok, word) r from mn)
  select doc, ev, n_mentions, sent_span, f.sent sent_first, f.tok tok_first, f.word as "trigger",
    case when f.sent is null then 'unk' when f.sent <= 0 then 'lead' when f.sent <= 2 then 'early' when f.sent <= 7 then 'mid' else 'late' end sent_bucket, true in_arg, n_role, n_entity_arg
  from (select doc, ev, count(*) n_mentions, count(distinct sent) sent_span, count(distinct role) n_role, count(*) filter (not filler) n_entity_arg from ag group by all) join f using (doc, ev) where r = 1""")
def kg_event_nodes(spark, sf):
    profile = G.argument_profile(arguments(spark, sf)).select("doc", "ev", "n_role", "n_entity_arg")
    return G.event_nodes(T.mentions(spark, sf), profile)


@query(f"""with {SQL_ARG} select doc, ev, count(distinct role) n_role, string_agg(distinct role, ',' order by role) roleset, coalesce(string_agg(distinct etype, ',' order by etype), '') etypeset,
  coalesce(bool_or(etype = '0'), false) has_person, coalesce(bool_or(etype = '1'), false) has_org, coalesce(bool_or(etype = '2'), false) has_loc, count(*) filter (not filler) n_entity_arg, count(*) filter (filler) n_span_arg from ag group by doc, ev""")
def kg_argument_profile(spark, sf):
    out = G.argument_profile(arguments(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("roleset", "etypeset")})


@query("select cast(o_orderkey as bigint) k, case when s is null then 'unk' when s = 0 then 'lead' when s <= 2 then 'early' when s <= 7 then 'mid' else 'late' end bucket from (select o_orderkey, case when o_orderkey % 13 = 12 then null else o_orderkey % 13 end s from orders)")
def kg_sentence_bucket(spark, sf):
    s = F.when(F.col("o_orderkey") % 13 != 12, F.col("o_orderkey") % 13)
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), S.sentence_bucket(s).alias("bucket"))


@query(f"with {X} select doc, tx, timex_type, timex_type in ('DATE', 'TIME') anchorable, text, sent sent_first, tok tok_first from tm")
def kg_timex_nodes(spark, sf):
    return G.timex_nodes(T.timexes(spark, sf))


@query(f"with {SQL_HAS_ARG} select doc, s, anchor, role, strength from he")
def kg_argument_edges(spark, sf):
    return has_arg(spark, sf)


@query(f"""with {SQL_HAS_ARG}, d as (select 'ENT_' || s_suppkey anchor, cast(n_regionkey as varchar) etype from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 10 <> 0)
  select doc, anchor, etype, etype is null stub, n_mentions, mentions from (select doc, anchor, count(*) n_mentions, array_to_string(list_sort(list(distinct role))[1:5], ',') mentions from he where strength = 'entity' group by all) left join d using (anchor)""")
def kg_entity_nodes(spark, sf):
    """A tenth of the suppliers is undeclared and so becomes stubs."""
    declared = T.table(spark, sf, "supplier").where("s_suppkey % 10 <> 0").join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return G.entity_nodes(has_arg(spark, sf), declared.select(F.concat(F.lit("ENT_"), F.col("s_suppkey").cast("string")).alias("anchor"), F.col("n_regionkey").cast("string").alias("etype")))


@query(f"""with {SQL_DIRTY}, ok as (select * from dt where s <> t and exists (select 1 from ev where ev.doc = dt.doc and ev.ev = dt.s) and exists (select 1 from ev where ev.doc = dt.doc and ev.ev = dt.t))
  select doc, s, t, rel from ok where rel not in {SYM} union all select distinct doc, least(s, t), greatest(s, t), rel from ok where rel in {SYM}""")
def kg_symmetric_canon(spark, sf):
    return G.relation_edges(dirty(spark, sf), T.events(spark, sf))


@query(f"with {SQL_WEAK} select * from we")
def kg_weak_edges(spark, sf):
    return G.weak_edges(weak_raw(spark, sf), T.events(spark, sf))


@query(f"with {SQL_HAS_ARG} select doc, anchor, count(distinct s) n_events from he group by all having count(distinct s) >= 2")
def kg_anchor_index(spark, sf):
    return G.anchor_index(has_arg(spark, sf))


@query(f"""with {SQL_HAS_ARG}, {E}, h2 as (select * from he where (doc, anchor) in (select (doc, anchor) from he group by doc, anchor having count(distinct s) >= 2)),
  ap as (select a.doc, a.s a, b.s b, count(distinct a.anchor) n_anchors, string_agg(distinct a.anchor, ',' order by a.anchor) anchors, string_agg(a.role || '/' || b.role, ',' order by a.role || '/' || b.role) roles,
    case when min(a.strength) = max(a.strength) then min(a.strength) else 'mixed' end strength from h2 a join h2 b on a.doc = b.doc and a.anchor = b.anchor and a.s < b.s group by all)
  select ap.*, abs(x.sent - y.sent) sdist, case when (x.sent, x.tok) < (y.sent, y.tok) then 'fwd' when (x.sent, x.tok) > (y.sent, y.tok) then 'rev' end torder
  from ap left join ev x on x.doc = ap.doc and x.ev = a left join ev y on y.doc = ap.doc and y.ev = b""")
def kg_anchored_pairs(spark, sf):
    return G.anchored_pairs(has_arg(spark, sf), T.events(spark, sf))


@query(f"with {P}, {SQL_HAS_ARG} select 'event' item, cast(type as varchar) kind, count(*) n from ev group by 2 union all select 'target', rel, count(*) from pr group by 2 union all select 'input', strength, count(*) from he group by 2")
def kg_build_statistics(spark, sf):
    return G.census({"event": (T.events(spark, sf), "type"), "target": (T.edges(spark, sf), "rel"), "input": (has_arg(spark, sf), "strength")})


@query(f"with {E} select doc, count(*) n from ev group by doc order by doc limit 25")
def kg_limit_documents(spark, sf):
    return files.head(T.events(spark, sf).groupBy("doc").agg(F.count(F.lit(1)).alias("n")), 25)


# -------------------------------------------------------------------- checks


def _sql_bad(check: str, what: str, source: str) -> str:
    return f"select '{check}' as \"check\", cast(doc as varchar) doc, {what} what from {source}"


_DANGLING = f"(select distinct doc, s, t, rel from dt where not exists (select 1 from ev where ev.doc = dt.doc and ev.ev = dt.s) or not exists (select 1 from ev where ev.doc = dt.doc and ev.ev = dt.t))"
_STR = "s || '|' || t || '|' || rel"


@query(f"with {SQL_DIRTY} " + _sql_bad("dangling", _STR, _DANGLING))
def vf_dangling(spark, sf):
    return VF.dangling(dirty(spark, sf), T.events(spark, sf))


@query(f"""with {SQL_HAS_ARG}, {E}, bd as (select doc, case when s % 101 = 0 then -s else s end s, case when s % 103 = 0 then cast(s as varchar) else anchor end anchor, role from he)
  select 'input_shape' as "check", cast(doc as varchar) doc, s || '|' || anchor || '|' || role what from (select distinct * from bd where not exists (select 1 from ev where ev.doc = bd.doc and ev.ev = bd.s) or exists (select 1 from ev where ev.doc = bd.doc and cast(ev.ev as varchar) = bd.anchor))""")
def vf_input_shape(spark, sf):
    s = F.col("s")
    bad = has_arg(spark, sf).select("doc", F.when(s % 101 == 0, -s).otherwise(s).alias("s"), F.when(s % 103 == 0, s.cast("string")).otherwise(F.col("anchor")).alias("anchor"), "role")
    return VF.input_shape(bad, T.events(spark, sf))


@query("select 'edges_target' as layer, '' as extra_columns, 0::bigint as n_extra union all select 'pairs_anchored', '', 0")
def vf_schema_guards(spark, sf):
    """Columns that the target layer and the anchored pairs may not carry: none."""
    target = VF.schema_only(T.edges(spark, sf), ("doc", "s", "t", "rel"))
    pairs = VF.no_label_columns(G.anchored_pairs(has_arg(spark, sf), T.events(spark, sf)))
    return spark.createDataFrame([("edges_target", ",".join(target), len(target)), ("pairs_anchored", ",".join(pairs), len(pairs))], "layer string, extra_columns string, n_extra long")


@query(f"with {SQL_DIRTY} " + _sql_bad("symmetric_order", _STR, f"dt where rel in {SYM} and s > t"))
def vf_symmetric_order(spark, sf):
    return VF.symmetric_order(dirty(spark, sf))


_TWO = "(select doc, s, t, count(distinct rel) n from dt group by all having count(distinct rel) > 1)"


@query(f"with {SQL_DIRTY} " + _sql_bad("two_labels", "s || '|' || t || '|' || n", _TWO))
def vf_two_labels(spark, sf):
    return VF.two_labels(dirty(spark, sf))


@query(f"with {SQL_DIRTY} " + _sql_bad("opposite_labels", _STR, "dt where s < t and exists (select 1 from dt b where b.doc = dt.doc and b.s = dt.t and b.t = dt.s)"))
def vf_opposite_labels(spark, sf):
    return VF.opposite_labels(dirty(spark, sf))


@query(f"with {SQL_DIRTY} " + _sql_bad("self_loop", _STR, "dt where s = t"))
def vf_self_loops(spark, sf):
    return VF.self_loops(dirty(spark, sf))


@query(f"""with {M}, {X}, n as (select doc, ev, case when ev % 53 = 0 then 0 else count(*) end n_mentions, count(distinct sent) sent_span from mn group by doc, ev)
  select 'event_node' as "check", cast(doc as varchar) doc, ev || '|' || n_mentions || '|' || sent_span what from n where n_mentions < 1 or sent_span > n_mentions
  union all select 'timex_node', cast(doc as varchar), tx || '|' || timex_type from tm where (timex_type = 'DATE' or tx like '%7') <> (timex_type in ('DATE', 'TIME'))""")
def vf_node_invariants(spark, sf):
    ev = G.event_nodes(T.mentions(spark, sf)).withColumn("n_mentions", F.when(F.col("ev") % 53 == 0, 0).otherwise(F.col("n_mentions")))
    tx = G.timex_nodes(T.timexes(spark, sf)).withColumn("anchorable", (F.col("timex_type") == "DATE") | F.col("tx").endswith("7"))
    return VF.node_invariants(ev, tx)


@query(f"""with {SQL_HAS_ARG}, h2 as (select * from he where (doc, anchor) in (select (doc, anchor) from he group by doc, anchor having count(distinct s) >= 2)),
  sh as (select distinct a.doc, a.s a, b.s b, a.anchor from h2 a join h2 b on a.doc = b.doc and a.anchor = b.anchor and a.s < b.s),
  cnt as (select doc, a, b, count(*) n from sh group by all), kept as (select * from he where (s * 3 + length(anchor)) % 29 <> 0)
  select distinct 'pair' as "check", cast(doc as varchar) doc, a || '|' || b || '|' || anchor what from (
    select doc, a, b, 'count' anchor from cnt where a % 31 = 0 union all
    select doc, a, b, anchor from sh where not exists (select 1 from kept k where k.doc = sh.doc and k.s = sh.a and k.anchor = sh.anchor) or not exists (select 1 from kept k where k.doc = sh.doc and k.s = sh.b and k.anchor = sh.anchor))""")
def vf_pair_consistency(spark, sf):
    """Pairs with planted wrong counts, against argument edges of which some were taken away."""
    edges = has_arg(spark, sf)
    pairs = G.anchored_pairs(edges, T.events(spark, sf)).withColumn("n_anchors", F.when(F.col("a") % 31 == 0, F.col("n_anchors") + 1).otherwise(F.col("n_anchors")))
    return VF.pair_consistency(pairs, edges.where((F.col("s") * 3 + F.length("anchor")) % 29 != 0))


@query(f"with {SQL_WEAK}, l as (select kind, count(*) n from wr group by 1), r as (select kind, count(*) n from we group by 1) select kind, coalesce(l.n, 0) n_left, coalesce(r.n, 0) n_right, coalesce(l.n, 0) - coalesce(r.n, 0) diff from l full join r using (kind)")
def vf_reconcile_weak(spark, sf):
    raw = weak_raw(spark, sf)
    return VF.reconcile(raw, G.weak_edges(raw, T.events(spark, sf)), "kind")


@query(f"with {SQL_ARG}, {SQL_WEAK} select 'weak' item, kind, count(*) n from we group by 2 union all select 'node', case when filler then 'span' else 'entity' end, count(*) from ag group by 2 union all select 'role', role, count(*) from ag group by 2")
def vf_census(spark, sf):
    args = arguments(spark, sf)
    return G.census({"weak": (G.weak_edges(weak_raw(spark, sf), T.events(spark, sf)), "kind"), "node": (args.withColumn("k", F.when(F.col("filler"), "span").otherwise("entity")), "k"), "role": (args, "role")})


@query(f"""with {SQL_DIRTY}, v as ({_sql_bad("dangling", _STR, _DANGLING)} union all {_sql_bad("self_loop", _STR, "dt where s = t")} union all {_sql_bad("symmetric_order", _STR, f"dt where rel in {SYM} and s > t")} union all {_sql_bad("two_labels", "s || '|' || t || '|' || n", _TWO)})
  select "check", n, example_rank, doc, what from (select *, count(*) over (partition by "check") n, row_number() over (partition by "check" order by doc, what) example_rank from v) where example_rank <= 3""")
def vf_report(spark, sf):
    d, ev = dirty(spark, sf), T.events(spark, sf)
    return VF.report([VF.dangling(d, ev), VF.self_loops(d), VF.symmetric_order(d), VF.two_labels(d)])
