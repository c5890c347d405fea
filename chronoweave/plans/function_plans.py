"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S
from chronoweave.functions import vocabulary as V
from chronoweave.plans.base import query
from chronoweave.sources import testdata as T

#: (k, n) from lineitem: quantity of a hundred tries, scaled by line number.
_KN = "kn as (select distinct cast(l_quantity as bigint) k, cast(50 + l_linenumber * 10 as bigint) n, l_discount + 0.05 p from lineitem)"


def _kn(spark, sf):
    return T.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("k"), (50 + F.col("l_linenumber") * 10).cast("long").alias("n"), (F.col("l_discount") + 0.05).alias("p")).distinct()


def sql_wilson(k: str, n: str, z: float = V.Z_EXACT) -> str:
    p = f"(({k}) / ({n})::double)"
    return f"(({p} + {z * z} / (2 * ({n})) - {z} * sqrt(({p} * (1 - {p}) + {z * z} / (4 * ({n}))) / ({n}))) / (1 + {z * z} / ({n})))"


def sql_erfc(x: str) -> str:
    c = ("-1.26551223", "1.00002368", "0.37409196", "0.09678418", "-0.18628806", "0.27886807", "-1.13520398", "1.48851587", "-0.82215223", "0.17087277")
    t = f"(1 / (1 + ({x}) / 2))"
    poly = c[-1]
    for v in reversed(c[:-1]):
        poly = f"({poly} * {t} + ({v}))"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def sql_tail(k: str, n: str, p: str) -> str:
    z = f"((({k}) - 0.5 - ({n}) * ({p})) / sqrt(({n}) * ({p}) * (1 - ({p}))))"
    return f"""case when {k} <= 0 or {p} <= 0 or {p} >= 1 or {k} <= {n} * {p} then 0.0
      when {z} > 8 then greatest((-{z} * {z} / 2 - ln({z}) - 0.5 * ln(2 * pi())) / ln(10), -300)
      else log10(greatest(0.5 * {sql_erfc(f'({z} / sqrt(2.0))')}, 1e-300)) end"""


def r6(c):
    """Rounded, with no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


@query(f"with {_KN} select k, n, p, round({sql_wilson('k', 'n')}, 6) + 0 wlb, round(greatest({sql_wilson('k', 'n', V.Z_TEXTBOOK)}, 0), 6) + 0 wlb_clamped from kn")
def fn_wilson(spark, sf):
    k, n = F.col("k"), F.col("n")
    return _kn(spark, sf).select("k", "n", "p", r6(S.wilson_lower(k, n)).alias("wlb"), r6(S.wilson_lower(k, n, V.Z_TEXTBOOK, clamp=True)).alias("wlb_clamped"))


@query(f"with {_KN} select k, n, p, round({sql_tail('k', 'n', 'p')}, 6) + 0 log10_tail from kn")
def fn_binomial_tail(spark, sf):
    return _kn(spark, sf).select("k", "n", "p", r6(S.log10_upper_tail(F.col("k"), F.col("n"), F.col("p"))).alias("log10_tail"))


@query(f"with {_KN} select k, n, p, round(ln(((k + 0.5) / (n + 1)) / (1 - (k + 0.5) / (n + 1))), 6) + 0 logit from kn")
def fn_smoothed_logit(spark, sf):
    return _kn(spark, sf).select("k", "n", "p", r6(S.smoothed_logit(F.col("k"), F.col("n"))).alias("logit"))


@query(f"""select target, min(k) least_k from (select t.i / 20.0 target, k.i k from (select unnest(generate_series(2, 19))::double i) t, (select unnest(generate_series(1, 200)) i) k) where 1 / (1 + {V.Z_EXACT**2} / k) >= target group by target""")
def fn_least_support(spark, sf):
    return spark.createDataFrame([(i / 20, S.least_support(i / 20)) for i in range(2, 20)], "target double, least_k long")


@query("""select k, case when d <= 0 then '0' when d <= 1 then '1' when d <= 3 then '2-3' when d <= 7 then '4-7' when d is null then 'unk' else '8+' end sdist,
  case when d is null or d > 3 then '4+' when d <= 0 then '0' when d <= 1 then '1' else '2-3' end bkt, case when d <= 3 then '<=3' when d <= 8 then '<=8' when d <= 15 then '<=15' else '>15' end tbkt
  from (select cast(o_orderkey as bigint) k, case when o_orderkey % 19 < 18 then o_orderkey % 19 end d from orders)""")
def fn_buckets(spark, sf):
    d = F.when(F.col("o_orderkey") % 19 < 18, F.col("o_orderkey") % 19)
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), S.distance_bucket(d).alias("sdist"), S.short_bucket(d).alias("bkt"), S.token_bucket(d).alias("tbkt"))


_WORDS = "wd as (select distinct w from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents))"


def _words(spark, sf):
    return T.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w")).distinct()


@query(f"""with {_WORDS} select w, case when w like '%ies' and length(w) > 6 then left(w, length(w) - 3) || 'y' when w like '%ied' and length(w) > 6 then left(w, length(w) - 3) || 'y'
  when w like '%ing' and length(w) > 6 then left(w, length(w) - 3) when w like '%ed' and length(w) > 5 then left(w, length(w) - 2) when w like '%es' and length(w) > 5 then left(w, length(w) - 2)
  when w like '%s' and length(w) > 4 then left(w, length(w) - 1) else w end lemma from wd""")
def fn_lemma(spark, sf):
    return _words(spark, sf).select("w", S.crude_lemma(F.col("w")).alias("lemma"))


@query(f"with {_WORDS} select w, case when regexp_matches(w, '{V.BEGIN_WORDS}') then 'BEGIN' when regexp_matches(w, '{V.END_WORDS}') then 'END' when regexp_matches(w, '{V.DURATION_WORDS}') then 'DUR' else 'none' end class from wd")
def fn_trigger_class(spark, sf):
    return _words(spark, sf).select("w", S.trigger_class(F.col("w")).alias("class"))


# Surface forms of the order dates, by the key's remainder.
_FORMS = """fm as (select cast(o_orderkey as bigint) k, case o_orderkey % 16 when 0 then strftime(d, '%Y') when 1 then strftime(d, '%B %Y') when 2 then strftime(d, '%-d %B %Y') when 3 then strftime(d, '%B %-d, %Y')
  when 4 then 'the ' || left(strftime(d, '%Y'), 3) || '0s' when 5 then strftime(d, '%B') when 6 then strftime(d, '%Y') || '-' || cast(year(d) + 2 as varchar) when 7 then 'a few days' when 8 then 'two days later' when 9 then 'a ten-year truce' when 10 then 'that same evening' when 11 then 'late ' || strftime(d, '%Y') when 12 then '14:30 UTC' when 13 then strftime(d, '%-d %b') when 14 then strftime(d, '%-d') else strftime(d, '%B %-d-28, %Y') end as text from (select o_orderkey, cast(o_orderdate as date) d from orders))"""


def _forms(spark, sf):
    d = F.col("o_orderdate").cast("date")
    year = F.date_format(d, "yyyy")
    forms = [year, F.date_format(d, "MMMM yyyy"), F.date_format(d, "d MMMM yyyy"), F.date_format(d, "MMMM d, yyyy"), F.concat(F.lit("the "), F.substring(year, 1, 3), F.lit("0s")), F.date_format(d, "MMMM"), F.concat(year, F.lit("-"), (F.year(d) + 2).cast("string")), F.lit("a few days")]
    forms += [F.lit("two days later"), F.lit("a ten-year truce"), F.lit("that same evening"), F.concat(F.lit("late "), year), F.lit("14:30 UTC"), F.date_format(d, "d MMM"), F.date_format(d, "d"), F.concat(F.date_format(d, "MMMM d"), F.lit("-28, "), year)]
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.get(F.array(*forms), (F.col("o_orderkey") % 16).cast("int")).alias("text"))


_MONTH_CASE = "case " + " ".join(f"when regexp_matches(lower(text), '\\b({m}|{m[:3]})\\b') then {i}" for i, m in enumerate(V.MONTHS, 1)) + " else 0 end"
_MONTH_ANY = "case " + " ".join(f"when contains(lower(text), '{m}') or list_contains(regexp_split_to_array(replace(lower(text), ',', ' '), '\\s+'), '{m[:3]}') then {i}" for i, m in enumerate(V.MONTHS, 1)) + " else 0 end"
_PARSED = f"""{_FORMS}, pd as (select *, case when y is null then 'none' when m = 0 then 'y' when d = 0 then 'ym' else 'ymd' end gran from (
  select *, case when y is null then null when m > 0 then (case when try_cast(regexp_extract(lower(text), '\\b([0-3]?[0-9])\\b', 1) as bigint) between 1 and 31 then try_cast(regexp_extract(lower(text), '\\b([0-3]?[0-9])\\b', 1) as bigint) else 0 end) else 0 end d from (
  select k, text, try_cast(nullif(regexp_extract(lower(text), '\\b(1\\d{{3}}|20\\d{{2}})\\b', 1), '') as bigint) y, case when regexp_matches(lower(text), '\\b(1\\d{{3}}|20\\d{{2}})\\b') then cast({_MONTH_ANY} as bigint) end m from fm)))"""


@query(f"with {_PARSED} select k, text, y, m, d, gran from pd")
def fn_parse_date(spark, sf):
    d = F.col("date")
    return _forms(spark, sf).withColumn("date", S.parse_date(F.col("text"))).select("k", "text", *[d[c].cast("long").alias(c) for c in "ymd"], S.granularity(d).alias("gran"))


@query(f"""with {_PARSED} select a.k, case when a.y is null or b.y is null then 'unk' when a.y < b.y then 'lt' when a.y > b.y then 'gt' when a.m = 0 and b.m = 0 then 'eq' when a.m = 0 then 'a_contains_b' when b.m = 0 then 'b_contains_a'
  when a.m < b.m then 'lt' when a.m > b.m then 'gt' when a.d = 0 and b.d = 0 then 'eq' when a.d = 0 then 'a_contains_b' when b.d = 0 then 'b_contains_a' when a.d < b.d then 'lt' when a.d > b.d then 'gt' else 'eq' end cal
  from pd a join pd b on b.k = a.k + 1""")
def fn_compare_dates(spark, sf):
    p = _forms(spark, sf).select("k", S.parse_date(F.col("text")).alias("a"))
    return p.join(p.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k").select("k", S.compare_dates(F.col("a"), F.col("b")).alias("cal"))


_SHAPE_SQL = " ".join("when " + " and ".join("regexp_matches(lower(trim(text)), '" + p.replace("'", "''") + "')" for p in patterns) + f" then '{name}'" for name, patterns in V.SHAPES)


@query(f"with {_FORMS} select k, text, case {_SHAPE_SQL} else 'OTHER' end shape from fm")
def fn_surface_shape(spark, sf):
    return _forms(spark, sf).select("k", "text", S.surface_shape(F.col("text")).alias("shape"))


_RANGE = r"""pr as (select k, text, case when a is not null then a when dec is not null then dec * 10 else one end lo_y, case when a is null and dec is null and one is not null then m end lo_m,
  case when a is not null then b when dec is not null then dec * 10 + 9 else one end hi_y, case when a is null and dec is null and one is not null then m end hi_m from (
  select k, text, try_cast(nullif(regexp_extract(lower(text), '(\d{4})\s*(?:-|to|and|until)\s*(\d{2,4})', 1), '') as bigint) a, try_cast(nullif(regexp_extract(lower(text), '(\d{4})\s*(?:-|to|and|until)\s*(\d{2,4})', 2), '') as bigint) b,
  try_cast(nullif(regexp_extract(lower(text), '\b(\d{3})0s\b', 1), '') as bigint) as dec, try_cast(nullif(regexp_extract(lower(text), '\b(\d{3,4})\b', 1), '') as bigint) as one, nullif(cast(MONTHCASE as bigint), 0) m from fm))""".replace("MONTHCASE", _MONTH_CASE)
_BOUNDS = "bd as (select k, text, lo_y * 12 + coalesce(lo_m, 1) lo, hi_y * 12 + coalesce(hi_m, 12) hi, case when lo_y is null then null when lo_m is not null then 'month' when lo_y = hi_y then 'year' else 'years' end unit from pr)"


@query(f"with {_FORMS}, {_RANGE}, {_BOUNDS} select k, text, lo, hi, unit from bd")
def fn_partial_range(spark, sf):
    b = F.col("b")
    return _forms(spark, sf).withColumn("b", S.range_bounds(S.partial_range(F.col("text")))).select("k", "text", b["lo"].cast("long").alias("lo"), b["hi"].cast("long").alias("hi"), b["unit"].alias("unit"))


@query(f"""with {_FORMS}, {_RANGE}, {_BOUNDS} select a.k, concat_ws(',', case when a.lo = b.lo and a.hi = b.hi then 'equal' end, case when a.lo = b.lo then 'same_start' end, case when a.hi = b.hi then 'same_end' end, case when a.hi < b.lo then 'before' end,
  case when b.hi < a.lo then 'after' end, case when a.lo <= b.lo and b.hi <= a.hi and (a.lo < b.lo or b.hi < a.hi) then 'contains' end, case when b.lo <= a.lo and a.hi <= b.hi and (b.lo < a.lo or a.hi < b.hi) then 'inside' end,
  case when a.hi + 1 = b.lo or b.hi + 1 = a.lo then 'touch' end) atoms from bd a join bd b on b.k = a.k + 1""")
def fn_calendar_atoms(spark, sf):
    p = _forms(spark, sf).select("k", S.range_bounds(S.partial_range(F.col("text"))).alias("a"))
    return p.join(p.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k").select("k", F.array_join(S.calendar_atoms(F.col("a"), F.col("b")), ",").alias("atoms"))


_TOKENS = "tk as (select cast(doc_id as bigint) k, string_split(replace(text, chr(10), ' '), ' ') tok from documents)"
_PREP = ", ".join(f"'{w}'" for w in V.PREPOSITIONS)


@query(f"""with {_TOKENS}, pl as (select k, cast(k % len(tok) as integer) p, list_transform(tok, lambda x: lower(x)) low from tk), w3 as (select k, p, low, low[greatest(p - 2, 1):p] before from pl)
  select k, array_to_string(list_filter(before, lambda x, i: x in ({_PREP}) and list_position(before, x) = i), ',') prep, concat_ws(',', 'p2=' || case when p >= 2 then low[p - 1] end, 'p1=' || case when p >= 1 then low[p] end, 'n1=' || low[p + 2]) ctx from w3""")
def fn_context_words(spark, sf):
    """Prepositions among the three tokens before a place of the whole text, and the neighbours of that place."""
    rows = _whole_tokens(spark, sf).withColumn("at", F.pmod("k", F.size("tok")).cast("int"))
    return rows.select("k", F.array_join(S.words_before(F.col("tok"), F.col("at"), 3, V.PREPOSITIONS), ",").alias("prep"), F.array_join(S.neighbour_words(F.col("tok"), F.col("at")), ",").alias("ctx"))


@query(f"""with {_TOKENS} select k, array_to_string(list_sort(list_distinct(list_filter(list_transform(tok[2:len(tok) - 1], lambda x: lower(x)), lambda x: x in ({", ".join(repr(w) for w in V.CONNECTIVES)})))), ',') conn,
  array_to_string(list_filter(regexp_extract_all(lower(array_to_string(tok, ' ')), '[a-z]+'), lambda x: length(x) > 2 and x not in ({", ".join(repr(m) for m in V.MONTHS)}))[1:4], ',') content from tk""")
def fn_connectives(spark, sf):
    """Connective words strictly between the first and the last token of the whole text, and its first content words."""
    conn = S.words_between(F.col("tok"), F.lit(0), F.size("tok") - 1, V.CONNECTIVES)
    return _whole_tokens(spark, sf).select("k", F.array_join(F.array_sort(conn), ",").alias("conn"), F.array_join(S.content_words(F.array_join("tok", " ")), ",").alias("content"))


def _whole_tokens(spark, sf) -> DataFrame:
    """``(k, tok)``: all tokens of each document."""
    return T.table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("k"), F.split(F.regexp_replace("text", "\n", " "), " ").alias("tok"))


def sql_md5_mod(text: str, m: int) -> str:
    digits = f"list_sum(list_transform(string_split(md5({text}), ''), lambda ch: strpos('0123456789abcdef', ch) - 1))"
    last = f"(strpos('0123456789abcdef', right(md5({text}), 1)) - 1)"
    if m == 2:
        return f"({last} % 2)"
    if m in (3, 5):
        return f"({digits} % {m})"
    return f"((6 * ({digits} % 5) + 5 * ({last} % 2)) % 10)"


def sql_split(doc: str) -> str:
    d = f"cast({doc} as varchar)"
    return f"case when {sql_md5_mod(d, 10)} >= 4 then 'DISC' when {sql_md5_mod(f'concat({chr(39)}s2{chr(39)}, {d})', 2)} = 0 then 'CONF-1' else 'CONF-2' end"


@query(f"""select cast(c_custkey as bigint) doc, {sql_split('c_custkey')} split, {sql_md5_mod("'v' || cast(c_custkey as varchar)", 5)} = 0 valid, cast({sql_md5_mod("'cf' || cast(c_custkey as varchar)", 2)} as bigint) fold,
  cast({sql_md5_mod("'in3' || cast(c_custkey as varchar)", 3)} as bigint) third, cast({sql_md5_mod("'kf' || cast(c_custkey as varchar)", 5)} as bigint) kfold from customer""")
def split_md5(spark, sf):
    doc = F.col("doc")
    folds = {"fold": ("cf", 2), "third": ("in3", 3), "kfold": ("kf", 5)}
    rows = T.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc"))
    return rows.select("doc", S.mining_split(doc).alias("split"), S.is_valid(doc).alias("valid"), *[S.hash_fold(doc, salt, m).cast("long").alias(c) for c, (salt, m) in folds.items()])


@query(f"""with {T.SQL_PAIRS} select rel, case when rel in ('SIMULTANEOUS', 'BEGINS-ON') then rel else 'i' || rel end back, rel again, count(*) n from pr group by all""")
def fn_read_backwards(spark, sf):
    rel = F.col("rel")
    return T.edges(spark, sf).select("rel", S.read_backwards(rel).alias("back"), S.read_backwards(S.read_backwards(rel)).alias("again")).groupBy("rel", "back", "again").agg(F.count(F.lit(1)).alias("n"))


@query("""select cast(o_orderkey as bigint) k, 'type_a = ' || o_orderpriority || ' and status = ' || o_orderstatus || ' => ' || printf('%.3f', (o_orderkey % 1000) / 1000.0) txt from orders""")
def fn_format_rule(spark, sf):
    conds = F.array_join(F.array(F.concat(F.lit("type_a = "), "o_orderpriority"), F.concat(F.lit("status = "), "o_orderstatus")), " and ")
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.format_string("%s => %.3f", conds, (F.col("o_orderkey") % 1000) / 1000.0).alias("txt"))
