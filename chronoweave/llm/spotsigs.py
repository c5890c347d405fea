"""SpotSigs fingerprints and their comparison (operator 7).

A spot is a common word (an anchor); its signature is the anchor with the chain of the next content words.  A text's
fingerprint is its set of signatures, and two texts are alike by the Jaccard likeness of their sets.  Sets fall into partitions
of size whose ends lie a factor of the threshold apart, so only sets of one or of two neighbouring partitions can reach it;
a comparison stops as soon as the overlap still possible is too small.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import cut, map_frames, partitions
from chronoweave.llm.components import components

# The anchors, common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "the a an of and to in is it that this for on with as was are be by at from or have has not"
    " le la les un une des de du et en est que qui dans pour sur au avec il elle ne pas"
    " der die das ein eine und ist von zu den dem mit nicht auf für sich im"
    " el los las una uno y es del al por con para se su lo como más no".split()
)
CHAIN = 2

_WORD = re.compile(r"\w+")


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a whole text.

    A chain that the text's end cuts short counts as it is.  A text without a full chain after any anchor takes every word
    for an anchor, so a text with a word has a signature; a text without one, and null, has none.
    """
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint32)
    content: list[str] = []
    spots: list[tuple[str, int]] = []  # the anchor, and how many content words stand before it
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    if not spots or spots[0][1] + chain > len(content):
        content, spots = words, [("", i) for i in range(len(words))]
    if chain == 2:
        ends = [*content, ""]
        found = {(a, content[i], ends[i + 1]) for a, i in spots if i < len(content)}
    else:
        found = {(a, *content[i : i + chain]) for a, i in spots if i < len(content)}
    digest, join = xxhash.xxh32_intdigest, " ".join
    return np.unique(np.fromiter((digest(join(s)) for s in found), np.uint32, len(found)))


def as_text(sigs: np.ndarray) -> str:
    """A set as text: base64 of its little-endian 32-bit values in order."""
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def partition_of(size: int, threshold: float) -> int:
    """Partition of a set by its size: sets that reach the threshold lie in one partition or in neighbouring ones."""
    return 0 if size < 1 else 1 + math.floor(math.log(size) / -math.log(threshold) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; two empty sets are alike.  0 as soon as ``least`` is out of reach."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < least * len(large):
        return 0.0
    if least > 0:
        # the overlap that the threshold asks for, and how many of the small set may be missing
        need = math.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9)
        block, missing, at = 64, 0, 0
        while at < len(small):
            part = small[at : at + block]
            i = np.searchsorted(large, part)
            missing += len(part) - int((large[np.minimum(i, len(large) - 1)] == part).sum())
            if len(small) - missing < need:
                return 0.0
            at += block
        common = len(small) - missing
    else:
        i = np.searchsorted(large, small)
        common = int((large[np.minimum(i, len(large) - 1)] == small).sum())
    return common / (len(a) + len(b) - common)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(splits: list[int]):
    if not splits:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(x) for x in splits]), lambda x: x <= F.col("key")))


def _splits(keys: DataFrame, per_range: int = 2_000, most: int = 4_096) -> list[int]:
    """Splits of ``key`` into ranges of about equal rows, each with at least one row but for ties."""
    n = keys.count()
    wanted = min(most, max(4 * partitions(keys.sparkSession), -(-n // per_range)))
    return sorted({int(x) for x in keys.approxQuantile("rank_key", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted))}) if n else []


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The order is by doc_id,
    rows without one first, rows of one id by text; the first follows the last.  Null is the empty text.  Rows are dealt by
    ranges of doc_id; the first rows of each range are also sent to the range before it, so no other row moves twice.
    """
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.select("key", F.col("key").cast("double").alias("rank_key"))
    own = _range_of(_splits(keys))
    firsts = [tuple(r) for r in keys.groupBy(own.alias("r")).agg(F.min("key").alias("first")).orderBy("r").collect()]  # a row a range
    # rows of a range's first id go to the range before it too, those of the very first id to the last range
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    copied = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<bigint,int>")
    places = F.array_compact(F.array(F.struct(own.alias("range"), F.lit(False).alias("halo")), F.when(F.col("key").isin(list(before)), F.struct(F.try_element_at(copied, F.col("key")).alias("range"), F.lit(True).alias("halo")))))
    dealt = rows.select("key", "doc_id", "text", F.explode(places).alias("at")).select("at.range", "at.halo", "key", "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # range, doc_id, text and signatures of the row whose next row is still to come
        for batch in batches:
            out = []
            for place, halo, doc_id, text in zip(batch["range"], batch["halo"], batch["doc_id"], batch["text"]):
                if held is None and halo or held is not None and held[0] != place and halo:
                    continue  # a further copy: the range's last row has its next one already
                sigs = signatures(text)
                if held is not None and held[0] == place:
                    _, own_id, own_text, own_sigs = held
                    edited = edited_text(own_text, text)
                    edited_sigs = signatures(edited)
                    out.append((own_id, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own_sigs), as_text(edited_sigs), likeness(own_sigs, edited_sigs), likeness(own_sigs, sigs)))
                held = None if halo else (place, doc_id, text, sigs)
            frame = pd.DataFrame(out, columns=_NAMES, dtype=object if not out else None)
            frame["doc_id"] = pd.array([x[0] for x in out], "Int64")
            yield frame

    n = partitions(docs.sparkSession)
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "halo", "key", "text")
    return map_frames(dealt, run, _SCHEMA)


# ---------------------------------------------------------------- near duplicates among all documents


def prefix_length(size: int, threshold: float) -> int:
    """Of two sets that reach the threshold these many first signatures, in one order for all, have one in common."""
    return size - math.ceil(threshold * size - 1e-9) + 1


def _sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, sigs)`` of each row with an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [signatures(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], "sigs": [x.astype(np.int64) for x in sets]})

    return map_frames(docs.where("doc_id is not null").select("doc_id", "text"), run, "doc_id long, digest binary, sigs array<long>")


def near_pairs(distinct: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b)``: pairs of rows of ``distinct(rep, sigs)``, a < b, whose likeness reaches the threshold; empty sets take no part.

    Sets lie in partitions of size and meet those of their own and of the next one that share a signature of their prefix,
    where signatures are ordered from rare to frequent over all documents, so that a passage that very many texts share brings
    few of them together.  Pairs that meet are compared by pruned Jaccard.
    """
    rows = distinct.where(F.size("sigs") > 0)
    often = rows.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # signatures that no other text has come first and bring nothing together: they only use up the prefix
    ranked = rows.select("rep", F.size("sigs").alias("size"), F.explode("sigs").alias("sig")).join(often, "sig", "left")
    ordered = ranked.groupBy("rep", "size").agg(F.count_if(F.col("n").isNull()).alias("alone"), F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "sig")))).alias("shared"))
    size = F.col("size")
    length = size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1
    taken = F.slice("shared", 1, F.greatest(F.lit(0), length - F.col("alone").cast("int")))
    part = (1 + F.floor(F.log(size.cast("double")) / -math.log(threshold) + 1e-9)).cast("int")
    prefixes = cut(ordered.select("rep", "size", part.alias("part"), F.explode(taken["sig"]).alias("sig")))
    own = prefixes.select(F.col("rep").alias("i"), F.col("size").alias("ni"), F.col("part").alias("pi"), "part", "sig")
    met = prefixes.select(F.col("rep").alias("j"), F.col("size").alias("nj"), F.col("part").alias("pj"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "sig")
    close = (F.least("ni", "nj") >= F.lit(threshold) * F.greatest("ni", "nj") - 1e-9) & ((F.col("pi") < F.col("pj")) | (F.col("i") < F.col("j")))
    pairs = own.join(met, ["part", "sig"]).where(close).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [likeness(x, y, threshold) >= threshold - 1e-12 for x, y in zip(batch["x"], batch["y"])]
            yield batch.loc[near, ["a", "b"]]

    of = lambda i, x: distinct.select(F.col("rep").alias(i), F.col("sigs").alias(x))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, class_id, n_links)`` of every row with an id.

    ``class_id`` is the smallest doc_id reachable over fingerprints whose likeness reaches the threshold, ``n_links`` the number
    of other fingerprints that the row's own is linked with.  Rows of equal fingerprints are one class; texts without a word,
    null among them, are one.  Rows that repeat an id tie their texts together.
    """
    rows = cut(_sets(docs))
    distinct = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sigs").alias("sigs")))
    links = cut(near_pairs(distinct.select("rep", "sigs"), threshold).where("a < b").distinct())
    counted = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of_row = rows.select("doc_id", "digest").join(distinct.select("digest", "rep"), "digest")
    same = of_row.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(same))
    out = of_row.join(counted, "rep", "left").join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
