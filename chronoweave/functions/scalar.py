"""Scalar Column functions: bounds and tests, buckets, words, dates, splits, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions import vocabulary as V

# ---------------------------------------------------------------- statistics


def wilson_lower(k: Column, n: Column, z: float = V.Z_EXACT, clamp: bool = False) -> Column:
    """Lower end of the Wilson interval of k successes in n trials; 0 where n is 0."""
    p, z2 = k / n, z * z
    bound = (p + z2 / (2 * n) - z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    bound = F.greatest(bound, F.lit(0.0)) if clamp else bound
    return F.when(n > 0, bound).otherwise(0.0)


def least_support(target: float, z: float = V.Z_EXACT) -> int:
    """Smallest k with wilson_lower(k, k) at or above ``target``: the bound of k in k is 1 / (1 + z^2 / k)."""
    k = max(1, int(z * z * target / (1 - target)) - 1)
    while 1 / (1 + z * z / k) < target:
        k += 1
    return k


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error at most 1.2e-7.

    Fixed values: the coefficients of the Chebyshev fit.
    """
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + x / 2)
    poly = reduce(lambda acc, c: acc * t + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))
    return t * F.exp(-x * x + poly)


def log10_upper_tail(k: Column, n: Column, p: Column) -> Column:
    """log10 of P(X >= k) for a binomial by its normal approximation with continuity correction.

    0 where k is not positive, p not inside (0, 1) or k at or below the mean; the asymptotic form beyond eight standard
    deviations; not below -300.
    """
    mean, sd = n * p, F.sqrt(n * p * (1 - p))
    z = (k - 0.5 - mean) / sd
    near = F.log10(F.greatest(0.5 * erfc(z / F.sqrt(F.lit(2.0))), F.lit(1e-300)))
    far = (-z * z / 2 - F.log(z) - 0.5 * F.log(F.lit(2.0) * F.pi())) / F.log(F.lit(10.0))
    tail = F.when(sd <= 0, -99.0).when(z > 8, F.greatest(far, F.lit(-300.0))).otherwise(near)
    return F.when((k <= 0) | (p <= 0) | (p >= 1) | (k <= mean), 0.0).otherwise(tail)


def smoothed_logit(k: Column, n: Column) -> Column:
    p = (k + 0.5) / (n + 1)
    return F.log(p / (1 - p))


# ------------------------------------------------------------------- buckets


def steps(x: Column, *bounds: tuple[int, str], beyond: str, missing: str | None = None) -> Column:
    """The name of the first bound that x does not exceed."""
    out = F.when(x.isNull(), missing) if missing is not None else None
    for most, name in bounds:
        out = F.when(x <= most, name) if out is None else out.when(x <= most, name)
    return out.otherwise(beyond)


def sentence_bucket(sent: Column) -> Column:
    """Where in its document a sentence stands."""
    return steps(sent, (0, "lead"), (2, "early"), (7, "mid"), beyond="late", missing="unk")


def distance_bucket(d: Column) -> Column:
    return steps(d, (0, "0"), (1, "1"), (3, "2-3"), (7, "4-7"), beyond="8+", missing="unk")


def short_bucket(d: Column) -> Column:
    return steps(d, (0, "0"), (1, "1"), (3, "2-3"), beyond="4+")


def token_bucket(d: Column) -> Column:
    return steps(d, (3, "<=3"), (8, "<=8"), (15, "<=15"), beyond=">15")


# --------------------------------------------------------------------- words

#: Suffixes in the order in which they are tried, and what takes their place.
SUFFIXES = (("ies", "y"), ("ied", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))


def crude_lemma(word: Column) -> Column:
    """Lower-case word without its first matching suffix, if more than three letters stay."""
    w = F.lower(F.trim(word))
    out = None
    for suffix, by in SUFFIXES:
        fits = w.endswith(suffix) & (F.length(w) > len(suffix) + 3)
        cut = F.concat(F.substring(w, F.lit(1), F.length(w) - len(suffix)), F.lit(by))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(w)


def trigger_class(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w.rlike(V.BEGIN_WORDS), "BEGIN").when(w.rlike(V.END_WORDS), "END").when(w.rlike(V.DURATION_WORDS), "DUR").otherwise("none")


def words_before(tokens: Column, at: Column, n: int, among: tuple[str, ...]) -> Column:
    """Distinct words of a list among the ``n`` tokens before position ``at`` (from 0), in lower case."""
    start = F.greatest(at - n, F.lit(0))
    return F.array_intersect(F.transform(F.slice(tokens, start + 1, at - start), F.lower), F.array(*map(F.lit, among)))


def words_between(tokens: Column, a: Column, b: Column, among: tuple[str, ...]) -> Column:
    """Distinct words of a list strictly between two positions."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.array_intersect(F.transform(F.slice(tokens, lo + 2, F.greatest(hi - lo - 1, F.lit(0))), F.lower), F.array(*map(F.lit, among)))


def content_words(text: Column, most: int = 4) -> Column:
    """First words of more than two letters that are no months."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    return F.slice(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*V.MONTHS)), 1, most)


def neighbour_words(tokens: Column, at: Column) -> Column:
    """Atoms of the two words before and the one behind a position, missing ones left out."""
    word = lambda i: F.lower(F.get(tokens, i))
    named = [F.concat(F.lit(f"{name}="), word(at + d)) for name, d in (("p2", -2), ("p1", -1), ("n1", 1))]
    guarded = [F.when(at + d >= 0, x) for x, d in zip(named, (-2, -1, 1))]
    return F.array_compact(F.array(*guarded))


# --------------------------------------------------------------------- dates


def parse_date(text: Column) -> Column:
    """``struct<y, m, d>``: the first year 1000 to 2099; the first month in calendar order whose name stands anywhere in the text
    or whose first three letters are a word of it; with a month the first number of one or two digits, if it is 1 to 31.

    Null without a year; month and day are 0 where missing.  Commas count as spaces.
    """
    low = F.translate(F.lower(text), ",", " ")
    year = F.regexp_extract(low, r"\b(1[0-9]{3}|20[0-9]{2})\b", 1)
    month = F.lit(0)
    for i, name in reversed(list(enumerate(V.MONTHS, 1))):
        month = F.when(low.contains(name) | low.rlike(rf"(^|\s){name[:3]}(\s|$)"), i).otherwise(month)
    day = F.try_to_number(F.regexp_extract(low, r"\b([0-3]?[0-9])\b", 1), F.lit("99")).cast("int")
    day = F.when((month > 0) & day.between(1, 31), day).otherwise(0)
    return F.when(year != "", F.struct(year.cast("int").alias("y"), month.alias("m"), day.alias("d")))


def granularity(date: Column) -> Column:
    return F.when(date.isNull(), "none").when(date["m"] == 0, "y").when(date["d"] == 0, "ym").otherwise("ymd")


def compare_dates(a: Column, b: Column) -> Column:
    """lt, gt, eq, a_contains_b, b_contains_a of two parsed dates; unk if one is missing."""
    result = F.when(a.isNull() | b.isNull(), "unk").when(a["y"] < b["y"], "lt").when(a["y"] > b["y"], "gt")
    for part in ("m", "d"):
        x, y = a[part], b[part]
        result = result.when((x == 0) & (y == 0), "eq").when(x == 0, "a_contains_b").when(y == 0, "b_contains_a").when(x < y, "lt").when(x > y, "gt")
    return result.otherwise("eq")




def surface_shape(text: Column) -> Column:
    """The first of ``V.SHAPES`` all of whose patterns the text holds, else OTHER; null is the empty text."""
    low, out = F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("OTHER")
    for name, patterns in reversed(V.SHAPES):
        fits = low.rlike(patterns[0])
        for pattern in patterns[1:]:
            fits = fits & low.rlike(pattern)
        out = F.when(fits, name).otherwise(out)
    return out


def partial_range(text: Column) -> Column:
    """``struct<lo_y, lo_m, hi_y, hi_m>`` of a year range, a decade, a month range of a year, or one date; BC is negative.

    Null where the text has no year.
    """
    low = F.lower(text)
    sign = F.when(low.rlike(r"\bbc\b"), -1).otherwise(1)
    a, b = F.regexp_extract(low, r"(\d{4})\s*(?:-|to|and|until)\s*(\d{2,4})", 1), F.regexp_extract(low, r"(\d{4})\s*(?:-|to|and|until)\s*(\d{2,4})", 2)
    decade = F.regexp_extract(low, r"\b(\d{3})0s\b", 1)
    single = F.regexp_extract(low, r"\b(\d{3,4})\b", 1)
    months = F.filter(F.array(*[F.when(low.rlike(rf"\b({m}|{m[:3]})\b"), i) for i, m in enumerate(V.MONTHS, 1)]), lambda m: m.isNotNull())
    short = F.when(F.length(b) == 2, F.concat(F.substring(a, 1, 2), b)).otherwise(b)
    part = lambda lo, lo_m, hi, hi_m: F.struct(lo.alias("lo_y"), lo_m.alias("lo_m"), hi.alias("hi_y"), hi_m.alias("hi_m"))
    none = F.lit(None).cast("int")
    as_int = lambda c: F.try_to_number(c, F.lit("9999")).cast("int")
    first_month, last_month = F.get(months, 0), F.get(months, F.size(months) - 1)
    return (
        F.when(a != "", part(sign * as_int(a), none, sign * as_int(short), none))
        .when(decade != "", part(sign * as_int(decade) * 10, none, sign * (as_int(decade) * 10 + 9), none))
        .when(single != "", part(sign * as_int(single), first_month, sign * as_int(single), last_month))
    )


def range_bounds(r: Column) -> Column:
    """First and last month of a partial range, counted from year 0, and its unit."""
    lo, hi = r["lo_y"] * 12 + F.coalesce(r["lo_m"], F.lit(1)), r["hi_y"] * 12 + F.coalesce(r["hi_m"], F.lit(12))
    unit = F.when(r["lo_m"].isNotNull(), "month").when(r["lo_y"] == r["hi_y"], "year").otherwise("years")
    return F.when(r.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), unit.alias("unit")))


def calendar_atoms(a: Column, b: Column) -> Column:
    """Atoms of two bounded ranges: equal, same_start, same_end, before, after, contains, inside, touch."""
    named = (
        ("equal", (a["lo"] == b["lo"]) & (a["hi"] == b["hi"])),
        ("same_start", a["lo"] == b["lo"]),
        ("same_end", a["hi"] == b["hi"]),
        ("before", a["hi"] < b["lo"]),
        ("after", b["hi"] < a["lo"]),
        ("contains", (a["lo"] <= b["lo"]) & (b["hi"] <= a["hi"]) & ((a["lo"] < b["lo"]) | (b["hi"] < a["hi"]))),
        ("inside", (b["lo"] <= a["lo"]) & (a["hi"] <= b["hi"]) & ((b["lo"] < a["lo"]) | (a["hi"] < b["hi"]))),
        ("touch", (a["hi"] + 1 == b["lo"]) | (b["hi"] + 1 == a["lo"])),
    )
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in named]))


# -------------------------------------------------------------------- splits

_DIGITS = "0123456789abcdef"


def _digit(hexadecimal: Column) -> Column:
    return F.instr(F.lit(_DIGITS), hexadecimal) - 1 if not isinstance(hexadecimal, str) else F.lit(_DIGITS.index(hexadecimal))


def md5_mod(text: Column, m: int) -> Column:
    """The md5 of a text, as a number, modulo 2, 3, 5 or 10, without large numbers.

    16 is 1 modulo 3 and 5, so the digits' sum decides there; the last digit decides modulo 2; both decide modulo 10.
    """
    h = F.md5(text.cast("binary"))
    if m == 2:
        return F.conv(F.substring(h, 32, 1), 16, 10).cast("int") % 2
    if m in (3, 5):
        halves = [F.conv(F.substring(h, i, 8), 16, 10).cast("bigint") for i in (1, 9, 17, 25)]  # 16^8 is 1 modulo 3 and 5
        return (sum(halves) % m).cast("int")
    if m == 10:
        return F.pmod(6 * md5_mod(text, 5) + 5 * md5_mod(text, 2), F.lit(10)).cast("int")
    raise ValueError("modulus must be 2, 3, 5 or 10")


def mining_split(doc: Column, seed: str = "") -> Column:
    """DISC for six tenths of the documents, CONF-1 and CONF-2 for the rest."""
    doc = doc.cast("string")
    first = md5_mod(F.concat(F.lit(seed), doc), 10)
    second = md5_mod(F.concat(F.lit(seed + "s2"), doc), 2)
    return F.when(first >= 4, "DISC").when(second == 0, "CONF-1").otherwise("CONF-2")


def is_valid(doc: Column) -> Column:
    """A fifth of the documents, opened once at the end."""
    return md5_mod(F.concat(F.lit("v"), doc.cast("string")), 5) == 0


def hash_fold(doc: Column, salt: str, m: int) -> Column:
    return md5_mod(F.concat(F.lit(salt), doc.cast("string")), m)


def hash_uniform(*parts: Column, seed: str = "") -> Column:
    """A number in [0, 1) from the md5 of the parts: the first 12 hexadecimal digits over 16^12."""
    h = F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") / float(16**12)


# -------------------------------------------------------------------- labels


def is_symmetric(rel: Column) -> Column:
    return rel.isin(*V.SYMMETRIC)


def read_backwards(rel: Column) -> Column:
    """A label seen from its edge's end."""
    return F.when(is_symmetric(rel), rel).when(rel.startswith("i"), F.substring(rel, 2, 100)).otherwise(F.concat(F.lit("i"), rel))


def oriented(rel: Column, backwards: Column) -> Column:
    return F.when(backwards, read_backwards(rel)).otherwise(rel)
