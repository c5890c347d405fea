"""SimHash fingerprints, linked through pivot distance tables (operator 10).

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's word shingles.  Linking works on distinct
fingerprints only, so copies cost one row.  The pivot table holds each fingerprint's Hamming distances to many fixed
reference fingerprints (the pivots), worked out once: by the triangle inequality two fingerprints within ``radius`` bits
differ by no more than ``radius`` in any coordinate.  Two coordinates bring pairs together: a row goes to the cell of both
and, where a coordinate is within ``radius`` of the next cell, there too, so near rows share a cell.  A third coordinate
orders a cell's rows, and a sweep compares neighbours while it differs by no more than the radius; the largest difference of
all coordinates then discards pairs, and the survivors are verified by their true distance.

One cell of three coordinates would still hold a fixed share of a large table.  So a cell is narrowed further by bits:
two fingerprints within ``radius`` agree on ``blocks - radius`` of ``blocks`` bit blocks, and every such choice of blocks is a
table of its own whose rows meet when those bits and the cell are equal.  Nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import TEXT_ROWS, cut, map_frames, partitions, sized
from chronoweave.llm.components import components

BITS = 64
SEED = 42
#: Hashes that are counted at a time, whatever the length of a text.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int = 3, seed: int = SEED) -> Iterator[int]:
    """XXH64 of every ``words``-word shingle, repeats included; A-Z in lower case; fewer words are one shingle."""
    # bytes.lower() and bytes.split() know ASCII letters and the six ASCII white-space characters only
    found = (text or "").encode().lower().split()
    if len(found) < words:
        if found:
            yield xxhash.xxh64_intdigest(b" ".join(found), seed)
        return
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for shingle in zip(*(found[i:] for i in range(words))):
        yield digest(join(shingle), seed)


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    hashes = shingle_hashes(text, words, seed)
    while True:
        some = np.fromiter((h for _, h in zip(range(CHUNK), hashes)), np.uint64)
        if not some.size:
            break
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += some.size
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)``: one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words, seed) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp.view(np.int64)})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def pivots(n: int, seed: int = 7) -> np.ndarray:
    """Fixed reference fingerprints: zero (whose distance is the bit count), then random ones."""
    return np.concatenate([np.zeros(1, np.uint64), np.random.default_rng(seed).integers(0, 2**64, n - 1, dtype=np.uint64)])


def _block_masks(blocks: int) -> list[int]:
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]


def table_masks(blocks: int, radius: int) -> list[int]:
    """The bits that each table keeps: all choices of ``blocks - radius`` blocks."""
    masks = _block_masks(blocks)
    return [sum(masks[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(n: int, radius: int) -> int:
    """Enough blocks that unrelated fingerprints seldom meet in a table, at most radius + 5."""
    if radius == 0:
        return 1
    for blocks in range(radius + 1, radius + 5):
        if n < 1 << (BITS * (blocks - radius) // blocks - 1):
            return blocks
    return radius + 5


#: Coordinates of the pivot table that name the cell; the one after them orders it.
CELLS = 2


def pivot_table(fp: Column, n_pivots: int) -> Column:
    """Distances of a fingerprint to the pivots, a byte each."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(p))))).cast("byte") for p in pivots(n_pivots)])


def _cells(coordinate: Column, width: int, radius: int) -> Column:
    """The cell of a coordinate, and the next one too from within ``radius`` of it."""
    cell = F.floor(coordinate / width).cast("int")
    return F.when(coordinate % width >= width - radius, F.array(cell, cell + 1)).otherwise(F.array(cell))


def _sweep(x: dict[str, np.ndarray], held: int, masks: np.ndarray, radius: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by (key, third coordinate), each pair once over all tables and cells.

    Pairs of two ``held`` rows have been seen before.
    """
    key, d, fp = x["key"], x["d"], x["fp"]
    order = d[:, CELLS]
    left, right = [], []
    at = np.arange(len(key) - 1)
    step = 1
    while at.size:
        at = at[at + step < len(key)]
        other = at + step
        open_ = (key[at] == key[other]) & (order[other] - order[at] <= radius)
        at, other = at[open_], other[open_]
        i, j = at[other >= held], other[other >= held]
        near = (np.abs(d[i] - d[j]) <= radius).all(axis=1)
        i, j = i[near], j[near]
        diff = fp[i] ^ fp[j]
        near = np.bitwise_count(diff) <= radius
        i, j, diff = i[near], j[near], diff[near]
        if i.size:
            mine = np.argmax((diff[:, None] & masks[None, :]) == 0, axis=1) == x["t"][i]
            for c in range(CELLS):
                mine &= np.maximum(d[i, c], d[j, c]) // width == x[f"c{c}"][i]
            left.append(x["rep"][i[mine]])
            right.append(x["rep"][j[mine]])
        step += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_links(distinct: DataFrame, radius: int = 2, n_pivots: int = 16, blocks: int | None = None) -> DataFrame:
    """``(a, b)``: every pair of rows of ``distinct(fp, rep)`` within ``radius`` bits, by their rep, each pair once."""
    if blocks is None:
        blocks = blocks_for(distinct.count(), radius)
    masks, width = table_masks(blocks, radius), max(4, 2 * radius)
    mask_array = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            new = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names if name != "d"}
            new["d"] = batch.column("d").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_pivots)
            new["fp"] = new["fp"].view(np.uint64)
            before = len(held["key"]) if held else 0
            x = {k: np.concatenate([held[k], v]) for k, v in new.items()} if before else new
            if not len(x["key"]):
                continue
            a, b = _sweep(x, before, mask_array, radius, width)
            # rows that may still be near the rows to come
            keep = (x["key"] == x["key"][-1]) & (x["d"][:, CELLS] >= x["d"][-1, CELLS] - radius)
            held = {k: v[keep] for k, v in x.items()}
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = distinct.select("fp", "rep", pivot_table(F.col("fp"), n_pivots).alias("d"))
    for c in range(CELLS):
        rows = rows.select("*", F.explode(_cells(F.get("d", F.lit(c)).cast("int"), width, radius)).alias(f"c{c}"))
    cells = [f"c{c}" for c in range(CELLS)]
    rows = rows.select("fp", "rep", "d", *cells, F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("t", "mask"))
    rows = rows.select(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "t", *cells).alias("key"), "d", "fp", "rep", "t", *cells)
    rows = rows.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key", F.get("d", F.lit(CELLS)))
    return rows.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, n_pivots: int = 16) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: component_id is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows stay repeated.  A row without doc_id
    keeps its row; its component is the smallest id of its group, null if no member has one.  Other columns are ignored.
    """
    fps = cut(fingerprints(docs, words))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(near_links(distinct.where("rep is not null"), radius, n_pivots))
    by_fp = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, the one with the smallest id; all columns of ``docs``, rows without an id stay."""
    kept = simhash_components(docs.where("doc_id is not null"), words, radius).where("doc_id = component_id").select("doc_id").distinct()
    return one_of_each_id(docs.join(kept, "doc_id", "left_semi"), docs.columns).unionByName(docs.where("doc_id is null"))


def one_of_each_id(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows that repeat an id the one of smallest text (null first), among equal texts that of smallest other columns."""
    order = F.struct("text", F.to_json(F.struct(*[c for c in columns if c != "text"])))
    return docs.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("_kept")).select("_kept.*")


# ----------------------------------------------------------------------------------------------- true likeness of shingles

#: MinHash bands of a text and values in each: a pair of likeness 0.8 shares no band with a chance of 1.3e-7.
BANDS, ROWS = 40, 5
#: Rounds that compare texts with one other text of a band, before all pairs of a band that are still apart are compared.
HUB_ROUNDS = 2
#: SimHash bits of a set of shingles; the first ``BITS`` of them are the fingerprint that the pivots link.
WIDE = 1_024
#: Bits within which the pivots link the fingerprints of sets.
REACH = 3
#: Standard errors by which a pair's SimHash bits may differ more than at the wanted similarity before they rule the pair out;
#: the chance for one at 0.8 is about 2e-8.
SLACK = 5.5
#: Texts of a band that are compared with the others' texts in one task; a larger band is dealt out in blocks.
BAND_BLOCK = 1_000
#: Bytes of shingle sets that a worker remembers while it verifies pairs.
REMEMBERED = 16 << 20


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(np.fromiter(shingle_hashes(text, words), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of ``shingle_set``; two empty sets are equal."""
    if not a.size and not b.size:
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True).size
    return common / (a.size + b.size - common)


def least_values(shingles: np.ndarray, seed: int = 11) -> np.ndarray:
    """MinHash values of a set that is not empty; sets of similarity j share a given one with chance j."""
    draws = np.random.default_rng(seed).integers(0, 2**32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    times, plus = draws[0] | np.uint32(1), draws[1]
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, high.size, 4_096):
        least = np.minimum(least, ((high[at : at + 4_096] ^ plus) * times).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One signed key for each band of ``least_values``."""
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), i)) for i, band in enumerate(least.reshape(BANDS, ROWS))]


_SALTS = np.random.default_rng(5).integers(0, 2**64, WIDE // BITS - 1, dtype=np.uint64)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WIDE`` SimHash bits of a set that is not empty, as unsigned numbers: the first from the hashes, the others from hashes of them."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, shingles.size, 255):
        some = shingles[at : at + 255, None]
        x = some ^ _SALTS
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x = np.concatenate([some, x ^ (x >> np.uint64(31))], axis=1)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > shingles.size, bitorder="little").view(np.uint64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, digest, n, keys, bits)`` of each row: digest and size of its shingle set, its bands' keys and SimHash bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingle_set(text, words)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((digest, found.size, band_keys(least_values(found)), wide_fingerprint(found).view(np.int64)) if found.size else (digest, 0, [], np.zeros(WIDE // BITS, np.int64)))
            digest, n, keys, bits = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": list(digest), "n": list(n), "keys": list(keys), "bits": list(bits)})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, digest binary, n int, keys array<long>, bits array<long>")


def most_apart(n, least: float, sqrt=np.sqrt):
    """SimHash bits by which two sets of similarity ``least``, the smaller one of ``n``, may differ.

    A bit differs in a share of them that is the angle between the sets over pi; in sets of few shingles it is more by up to
    0.15 / n (all pairs of up to 60 common shingles at 0.8 were worked out).
    """
    share = math.acos(2 * least / (1 + least)) / math.pi + 0.15 / n
    return WIDE * share + SLACK * sqrt(WIDE * share * (1 - share))


def plausible(i: str, j: str, least: float) -> Column:
    """Whether the sizes and the SimHash bits in the structs ``i`` and ``j`` allow a similarity of ``least``."""
    small, large = F.least(f"{i}.n", f"{j}.n"), F.greatest(f"{i}.n", f"{j}.n")
    differing = sum(F.bit_count(F.col(f"{i}.bits")[k].bitwiseXOR(F.col(f"{j}.bits")[k])) for k in range(WIDE // BITS))
    return (small >= F.lit(least) * large - 1e-6) & (differing <= most_apart(small, least, F.sqrt))


def pivot_pairs(rows: DataFrame, n: int) -> DataFrame:
    """``(a, b)``, a < b: texts whose fingerprints are within ``REACH`` bits by the pivot table; ``rows`` are the ``n`` of ``_sets``.

    Texts of one fingerprint are paired with the smallest of them, which is paired with those of other fingerprints.
    """
    fps = cut(sized(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first(F.get("bits", F.lit(0))).alias("fp")).select("rep", "fp"), n))
    one = cut(sized(fps.groupBy("fp").agg(F.min("rep").alias("a")), n))
    same = fps.join(one, "fp").select("a", F.col("rep").alias("b"))
    found = near_links(one.select("fp", F.col("a").alias("rep")), REACH)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same).where("a < b").distinct()


def _across(rows: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """``(a, b)``, repeated: true links between texts of a band that are in different components, one outside the largest.

    ``rows`` is ``(key, met, rep, n, c, outside, bits)``.  A band's texts are dealt out in blocks and those outside go to every
    block of their band, so a task holds one block.  SimHash bits first tell which texts of a block a text outside may be
    near to; then the texts that are left come to the block once each and their shingles decide.  A pair is never a row.
    """
    n_parts = partitions(rows.sparkSession)
    blocks = F.ceil(F.col("met") / BAND_BLOCK).cast("int")
    own = rows.select("key", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.lit(0).alias("asks"), "rep", "n", "c", "bits")
    asking = rows.where("outside").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("asks"), "rep", "n", "c", "bits")
    names = ("key", "block", "asks", "rep", "n", "c")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts outside with the texts of the block that they may be near to, and of those texts."""
        here, held, needed = None, [], np.zeros(0, bool)
        for batch in batches:
            key, block, asks, rep, n, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in names)
            bits = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, WIDE // BITS)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]))) if len(key) else []
            out: list[tuple] = []
            for at, end in zip(starts, [*starts[1:], len(key)]):
                if here != (key[at], block[at]):
                    here, held, needed = (key[at], block[at]), [], np.zeros(0, bool)
                if not asks[at]:
                    held.append((rep[at:end], n[at:end], c[at:end], bits[at:end]))
                    continue
                if not held:
                    continue
                held = [tuple(np.concatenate(x) for x in zip(*held))]
                r, m, d, k = held[0]
                needed = np.resize(needed, len(r)) if len(needed) else np.zeros(len(r), bool)
                for i in range(at, end):
                    may = np.flatnonzero((d != c[i]) & (np.minimum(m, n[i]) >= least * np.maximum(m, n[i]) - 1e-6))
                    may = may[np.bitwise_count(k[may] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most_apart(np.minimum(m[may], n[i]), least)]
                    if len(may):
                        # the block's texts by their number in it, as bits
                        out.append((*here, 1, rep[i], np.packbits(np.bincount(may).astype(bool)).tobytes()))
                        out += [(*here, 0, r[x], int(x).to_bytes(4, "little")) for x in may[~needed[may]].tolist()]
                        needed[may] = True
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary())], ["key", "block", "asks", "rep", "near"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, sets = None, {}
        for batch in batches:
            links = []
            for key, block, asks, rep, near, text in zip(batch["key"], batch["block"], batch["asks"], batch["rep"], batch["near"], batch["text"]):
                if here != (key, block):
                    here, sets = (key, block), {}
                found = shingle_set(text, words)
                if not asks:
                    sets[int.from_bytes(near, "little")] = rep, found
                    continue
                for x in np.flatnonzero(np.unpackbits(np.frombuffer(near, np.uint8))).tolist():
                    if x in sets and jaccard(found, sets[x][1]) >= least:
                        links.append((min(rep, sets[x][0]), max(rep, sets[x][0])))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    dealt = own.unionByName(asking).repartition(n_parts, "key", "block").sortWithinPartitions("key", "block", "asks")
    left = dealt.mapInArrow(sift, "key long, block int, asks int, rep long, near binary").join(texts, "rep").select("key", "block", "asks", "rep", "near", "text")
    return left.repartition(n_parts, "key", "block").sortWithinPartitions("key", "block", "asks", "rep").mapInPandas(decide, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose whole texts have a true similarity of ``least`` or more; ``texts`` is ``(rep, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def of(i: int, text: str) -> np.ndarray:
            nonlocal held
            if i not in known:
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                known[i] = shingle_set(text, words)
                held += known[i].nbytes
            return known[i]

        for batch in batches:
            near = [jaccard(of(a, x), of(b, y)) >= least for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"])]
            yield batch.loc[near, ["a", "b"]]

    text = lambda i, t: texts.select(F.col("rep").alias(i), F.col("text").alias(t))
    return pairs.join(text("a", "x"), "a").join(text("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def similar_components(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` of every row with an id: the smallest doc_id reachable over pairs of similarity ``least``.

    Equal sets are one row.  Pivots link the SimHash fingerprints of the sets within ``REACH`` bits, and each text is compared
    with the one of its partners that has the most.  At 0.8 most fingerprints are farther apart than any radius that pivots can
    tell from unrelated ones, so texts also meet in the MinHash bands that they share, where only texts of different components
    are compared.  First, beside the links of the pivots that are left, each text with one text of its bands, the one with
    the most partners: the origin of a group of edited copies, so that the group is joined by as many comparisons as it has
    texts.  Then a band's texts outside its largest component with one text of that component, and at last with every text
    of the band that is in another component than theirs.  So no pair inside a component is looked at, and no link that joins
    two components is left out.  Sizes and ``WIDE`` SimHash bits rule out unlikely pairs, and a link counts only if the whole
    texts' Jaccard similarity says so.  Rows that share an id are one document: it has the links of each of them.
    """
    docs = docs.where("doc_id is not null")
    rows = cut(_sets(docs, words))
    n = rows.count()
    # steps have as many partitions as they need, since each is a file or two of its checkpoint
    near = cut(sized(pivot_pairs(rows, n), BANDS * n))
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    keyed = distinct.select(F.explode("keys").alias("key"), "rep")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    bands = cut(sized(keyed.join(met, "key").select("key", "rep", "met"), BANDS * n))
    bands = sized(bands, bands.count())
    # only texts that meet another one move
    meeting = bands.select("rep").unionByName(near.select(F.col("a").alias("rep"))).unionByName(near.select(F.col("b").alias("rep")))
    texts = cut(sized(docs.select(F.col("doc_id").alias("rep"), "text").join(meeting.distinct(), "rep", "left_semi"), n, TEXT_ROWS))
    seen = lambda i, x: rows.select(F.col("doc_id").alias(i), F.struct("n", "bits").alias(x))

    def true_links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``(rep, other)``."""
        pairs = pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).where("a < b").distinct()
        pairs = pairs.join(seen("a", "x"), "a").join(seen("b", "y"), "b").where(plausible("x", "y", least)).select("a", "b").distinct()
        return cut(sized(_verified(pairs, texts, words, least), n, TEXT_ROWS))

    # of equally many partners the smallest id
    rank = lambda i: F.struct("partners", F.bitwise_not(i).alias("last"))
    sides = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = sides.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("partners"))
    hubs = sides.join(degrees, "b").groupBy(F.col("a").alias("rep")).agg(F.max(rank("b")).alias("hub"))
    links = true_links(hubs.select("rep", F.bitwise_not("hub.last").alias("other")))
    for turn in range(HUB_ROUNDS + 1):
        found = components(links, rows=n)
        if turn == 0:
            partners = bands.groupBy("rep").agg(F.sum("met").alias("partners"))
            ranked = bands.select("key", "rep").join(partners, "rep").select("key", "rep", rank("rep").alias("rank"))
            hubs = ranked.groupBy("key").agg(F.max("rank").alias("hub"))
            pairs = ranked.join(hubs, "key").groupBy("rep").agg(F.max("hub").alias("hub")).select("rep", F.bitwise_not("hub.last").alias("other"))
            pairs = pairs.unionByName(near.select(F.col("a").alias("rep"), F.col("b").alias("other")))
            of = lambda i: found.select(F.col("node").alias(i), F.col("component").alias(f"c_{i}"))
            pairs = pairs.join(of("rep"), "rep", "left").join(of("other"), "other", "left").where("coalesce(c_rep, rep) <> coalesce(c_other, other)")
        else:
            now = bands.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "met", F.coalesce("component", "rep").alias("c"))
            # a band's components: how many texts each has, and one of them, another one in each band
            order = F.struct(F.xxhash64("rep", "key").alias("h"), "rep")
            per = now.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.min(order).alias("hub"))
            main = per.groupBy("key").agg(F.count(F.lit(1)).alias("apart"), F.max(F.struct("m", "c", "hub")).alias("main")).where("apart > 1").select("key", F.col("main.c").alias("mc"), F.col("main.hub.rep").alias("other"))
            now = now.join(main, "key")
            pairs = now.where("c <> mc").select("rep", "other")
        if turn < HUB_ROUNDS:
            more = true_links(pairs)
        else:
            apart = now.select("key", "met", "rep", "c", (F.col("c") != F.col("mc")).alias("outside"))
            sets = rows.select(F.col("doc_id").alias("rep"), "n", "bits")
            more = cut(sized(_across(apart.join(sets, "rep"), texts, words, least).where("a < b").distinct(), n))
        links = links.unionByName(more)
    # repeated ids tie their texts together, so the links run over ids: equal sets point to their smallest one
    same = rows.select("doc_id", "digest").join(rows.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = components(links.unionByName(same), rows=2 * n)
    return docs.select("doc_id").join(whole, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component of ``similar_components``, as ``keep_one`` does of fingerprints."""
    gone = similar_components(docs, words, least).where("doc_id <> component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    return one_of_each_id(one, docs.columns).unionByName(docs.where("doc_id is null"))
