"""Removal of repeated substrings of at least ``length`` bytes over all documents (operator 8).

A repeat of ``length`` bytes is found by the anchor of its window: the leftmost ``GRAM`` bytes of smallest hash inside it, which
equal windows share at the same offset.  Consecutive windows with one anchor are an occurrence.  Occurrences meet by the
anchor's hash, and hashes only propose: an occurrence whose hash equals that of an earlier one becomes a claim on the earlier
one's place, adjoining claims with the same offset to it become one, and first occurrences that share an anchor but differ
around it are proposed with one another.  Suffix arrays (two-stage sorting, see ``suffixes``) decide: the bytes of a claim and of
its place, or of all first occurrences of one surrounding, are sorted together, neighbours with a common prefix of ``length``
bytes are equal windows, and all but the first are repeats.  Of pieces with the same bytes two are sorted; further ones are
compared with the first as bytes and share what was found for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import cut, map_frames, partitions
from chronoweave.llm.suffixes import adjacent_prefixes, suffix_array, words

GRAM = 24
#: Bytes that are hashed at a time; a longer document is taken in parts whose windows do not overlap.
PART = 1 << 20
#: Occurrences that a task gathers before it passes on the first of each kind.
GATHERED = 1_000_000
#: Bytes of the groups that share a suffix array, and of the pieces that a task passes on at a time.
ARRAY_BYTES = 1 << 19
#: Windows of a claim that are sorted together; a longer claim is several.
SEGMENT = 1 << 16
NO_ID = -(2**63)
SEPARATOR = 0xFF  # never a byte of UTF-8

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """Polynomial hashes modulo 2^64 of any substring from prefix sums; bytes stand for fixed random numbers."""

    def __init__(self) -> None:
        self.letters = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


def occurrences(data: np.ndarray, ends: np.ndarray, hasher: Hasher, length: int) -> dict[str, np.ndarray] | None:
    """Occurrences in joined pieces: first and last window, anchor, the anchor's hash and that of all their bytes.

    ``ends`` are the pieces' ends in ``data``; windows lie inside one piece.
    """
    gram = min(GRAM, length)
    n = len(data)
    if n < length:
        return None
    sums = hasher.sums(data)
    grams = _mix((sums[gram:] - sums[:-gram]) * hasher.down[: n - gram + 1])
    ranked = (grams & _U(0xFFFFFFFF00000000)) | np.arange(n - gram + 1, dtype=np.uint64)
    owner = (sliding_least(ranked, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(n, bool)
    starts = np.concatenate([[0], ends[:-1]])
    for a, b in zip(np.maximum(starts, ends - length + 1), ends):
        valid[a:b] = False
    at = np.flatnonzero(valid[: n - length + 1])
    if not len(at):
        return None
    own = owner[at]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))
    first, last, anchor = at[new], at[np.append(new[1:] - 1, len(at) - 1)], own[new]
    whole = hasher.of(sums, first, last + length)
    shape = ((anchor - first) << 16 | (last - first)).astype(np.uint64)
    return {"first": first, "last": last, "anchor": anchor, "h": grams[anchor].view(np.int64), "c": _mix(whole + _mix(shape + _U(1))).view(np.int64)}


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the text column and the offsets of its rows; nulls are empty."""
    column = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _parts(keys: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces to hash together: keys, where each starts in its document, and its ends in the batch's bytes."""
    group: list[tuple[int, int, int, int]] = []
    size = 0
    for key, a, b in zip(keys.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        start = a
        while b - start >= length:
            stop = min(b, start + PART + length - 1)
            group.append((key, start - a, start, stop))
            size += stop - start
            if size >= PART:
                yield tuple(np.array(x, np.int64) for x in zip(*group))
                group, size = [], 0
            if stop == b:
                break
            start += PART
    if group:
        yield tuple(np.array(x, np.int64) for x in zip(*group))


_NONE = np.zeros(0, np.int64)
#: An occurrence: anchor's hash, hash of all bytes, key, and first window and shape as one number.  A claim that is known
#: where it was read: key and first window of the place, key, and -1 less first and last window as one number.
_FOUND = "h long, c long, key long, place long"


def _joined_claims(key: np.ndarray, first: np.ndarray, last: np.ndarray, lead: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Claims of windows ``first`` to ``last`` on those from ``at`` of ``lead``; adjoining ones with the same offset joined."""
    if not len(key):
        return key, first, last, lead, at
    by = np.lexsort((first, first - at, lead, key))
    key, first, last, lead, at = (x[by] for x in (key, first, last, lead, at))
    same = (key[1:] == key[:-1]) & (lead[1:] == lead[:-1]) & (first[1:] - at[1:] == first[:-1] - at[:-1]) & (first[1:] <= last[:-1] + 1)
    new = np.flatnonzero(np.append(True, ~same))
    return key[new], first[new], np.maximum.reduceat(last, new), lead[new], at[new]


def _read(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[dict[str, np.ndarray]] = []

        def give() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            x = {k: np.concatenate([y[k] for y in held]) for k in held[0]}
            held.clear()
            by = np.lexsort((x["first"], x["key"], x["h"], x["c"]))
            x = {k: v[by] for k, v in x.items()}
            again = np.append(False, (x["c"][1:] == x["c"][:-1]) & (x["h"][1:] == x["h"][:-1]))
            # the same place of a repeated row is no earlier place
            lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
            again &= (x["key"] != x["key"][lead]) | (x["first"] != x["first"][lead])
            new = {k: v[~again] for k, v in x.items()}
            mine, place = np.flatnonzero(again), lead[again]
            key, first, last, to, at = _joined_claims(x["key"][mine], x["first"][mine], x["last"][mine], x["key"][place], x["first"][place])
            columns = [
                np.concatenate([new["h"], to]),
                np.concatenate([new["c"], at]),
                np.concatenate([new["key"], key]),
                np.concatenate([new["first"] << 32 | (new["anchor"] - new["first"]) << 16 | (new["last"] - new["first"]), -1 - (first << 32 | last)]),
            ]
            for start in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 50_000]) for c in columns], ["h", "c", "key", "place"])

        gathered = 0
        for batch in batches:
            data, offsets = _texts(batch)
            for key, inside, start, stop in _parts(batch.column("key").to_numpy(zero_copy_only=False), offsets, length):
                joined = np.concatenate([data[a:b] for a, b in zip(start, stop)])
                ends = np.cumsum(stop - start)
                found = occurrences(joined, ends, hasher, length)
                if found is None:
                    continue
                piece = np.searchsorted(ends, found["first"], side="right")
                shift = inside[piece] - (ends - (stop - start))[piece]
                held.append({"h": found["h"], "c": found["c"], "key": key[piece], "first": found["first"] + shift, "last": found["last"] + shift, "anchor": found["anchor"] + shift})
                gathered += len(piece)
                if gathered >= GATHERED:
                    yield from give()
                    gathered = 0
        yield from give()

    return run


_MET = ["key", "first", "last", "lead", "at", "shape", "h"]


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by h, c, key, place: claims on earlier occurrences, and first occurrences whose anchor has different ones.

    ``shape`` belongs to an occurrence to compare, and is -1 for a claim.  One row is carried between batches.
    """
    lead = None  # h, c, key, first of the first occurrence of the current kind
    pending = None  # the newest first occurrence, if its anchor has had no other yet
    shared = False  # whether the current anchor has had another kind
    for batch in batches:
        place = batch["place"].to_numpy()
        known = place < 0
        done, span = batch[known], -1 - place[known]
        rows = batch[~known]
        out = [pd.DataFrame({"key": done["key"], "first": span >> 32, "last": span & 0xFFFFFFFF, "lead": done["h"], "at": done["c"], "shape": -1, "h": 0})]
        n = len(rows)
        if n:
            h, c, key, place = (rows[x].to_numpy(np.int64) for x in ("h", "c", "key", "place"))
            first, shape = place >> 32, place & 0xFFFFFFFF
            same_h = np.append(lead is not None and lead[0] == h[0], h[1:] == h[:-1])
            same = same_h & np.append(lead is not None and lead[1] == c[0], c[1:] == c[:-1])
            at = np.where(same, -1, np.arange(n))
            at = np.maximum.accumulate(at)
            lead_key = np.where(at < 0, lead[2] if lead else 0, key[at])
            lead_first = np.where(at < 0, lead[3] if lead else 0, first[at])
            again = same & ((key != lead_key) | (first != lead_first))
            if again.any():
                out.append(pd.DataFrame({"key": key[again], "first": first[again], "last": first[again] + (shape[again] & 0xFFFF), "lead": lead_key[again], "at": lead_first[again], "shape": -1, "h": 0}))
            new = np.flatnonzero(~same)
            if len(new):
                joins = np.append(same_h[new[0]], h[new[1:]] == h[new[:-1]])  # another kind of the anchor came before
                if joins[0] and pending is not None and not shared:
                    out.append(pd.DataFrame([pending], columns=_MET))
                followed = np.append(joins[1:], False)
                compare = new[joins | followed]
                out.append(pd.DataFrame({"key": key[compare], "first": first[compare], "last": -1, "lead": 0, "at": 0, "shape": shape[compare], "h": h[compare]}))
                z = new[-1]
                shared = bool(joins[-1])
                pending = (key[z], first[z], -1, 0, 0, shape[z], h[z])
                lead = (h[z], c[z], key[z], first[z])
        yield pd.concat(out, ignore_index=True).astype("int64")


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key: joined claims in segments.  A claim that goes on in the next batch stays in two parts."""
    for batch in batches:
        key, first, last, lead, at = _joined_claims(*(batch[c].to_numpy(np.int64) for c in ("key", "first", "last", "lead", "at")))
        parts = (last - first) // SEGMENT + 1
        which = np.repeat(np.arange(len(key)), parts)
        shift = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        start = first[which] + shift
        yield pd.DataFrame({"key": key[which], "first": start, "last": np.minimum(last[which], start + SEGMENT - 1), "lead": lead[which], "at": at[which] + shift})


def _contexts(length: int):
    """Bytes to sort: of claims and their places, and of the occurrences to compare.

    The latter come in two kinds by where the window lies around its anchor: a window has half of its other bytes before the
    anchor or half behind it, so equal windows agree on the anchor and that half; occurrences are dealt by the hash of both,
    which few unequal ones share.
    """
    gram = min(GRAM, length)
    half = (length - gram + 1) // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for key, text, places in zip(batch["key"], batch["text"], batch["places"]):
                data = text.encode()
                for place in places:
                    first, shape = place["first"], place["shape"]
                    if shape < 0:
                        last = place["last"]
                        if last + length <= len(data):  # else of another row with this id
                            out.append((place["group"], key, first, data[first : last + length]))
                            size += len(out[-1][3])
                        continue
                    last, anchor = first + (shape & 0xFFFF), first + (shape >> 16)
                    if last + length > len(data):
                        continue
                    left, right = (first, min(last, anchor - half)), (max(first, anchor - half + 1), last)
                    if left[0] <= left[1]:
                        out.append((_key(b"l", data[anchor - half : anchor + gram]), key, left[0], data[left[0] : left[1] + length]))
                        size += len(out[-1][3])
                    if right[0] <= right[1]:
                        out.append((_key(b"r", data[anchor : anchor - half + 1 + length]), key, right[0], data[right[0] : right[1] + length]))
                        size += len(out[-1][3])
                    if size >= ARRAY_BYTES:
                        yield pd.DataFrame(out, columns=["group", "key", "first", "data"])
                        out, size = [], 0
                if size >= ARRAY_BYTES:
                    yield pd.DataFrame(out, columns=["group", "key", "first", "data"])
                    out, size = [], 0
        yield pd.DataFrame(out, columns=["group", "key", "first", "data"])

    return run


def _key(kind: bytes, data: bytes) -> int:
    """A group's number: even, since the groups of claims have the odd ones."""
    return ~1 & int.from_bytes(hashlib.blake2b(data, digest_size=8, person=kind).digest(), "little", signed=True)


def repeats_in(keys: np.ndarray, firsts: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of pieces of documents that an earlier piece (smaller key, then smaller start) has, as merged ranges."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    t = np.frombuffer(bytes([SEPARATOR]).join(pieces), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    window = np.zeros(len(t), bool)
    for a, n in zip(starts, sizes):
        window[a : a + n - length + 1] = True
    w = words(t)
    order = suffix_array(t, length, w)
    order = order[window[order]]
    equal = adjacent_prefixes(w, order, length) >= length
    group = np.cumsum(~equal)
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    if not len(order):
        return _NONE, _NONE, _NONE
    piece = np.searchsorted(starts, order, side="right") - 1
    ids, code = np.unique(keys, return_inverse=True)
    place = code[piece] << 33 | firsts[piece] + order - starts[piece]  # in the order of documents and places in them
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    lead = np.repeat(np.minimum.reduceat(place, begin), np.diff(np.append(begin, len(group))))
    place = np.unique(place[place != lead])
    if not len(place):
        return _NONE, _NONE, _NONE
    new = np.append(True, place[1:] != place[:-1] + 1)
    first, last = place[new], place[np.append(new[1:], True)]
    return ids[first >> 33], first & 0x1FFFFFFFF, last & 0x1FFFFFFFF


def _arrays(length: int):
    """Sorted by group, key, first: repeats among the pieces of each group.

    Groups of few bytes share a suffix array.  In a group two pieces of the same bytes are sorted, further ones are repeats of
    the first.  All pieces of a claims' group are compared with its first one, the place, so a large group of those is sorted
    in parts that each hold the place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, bytes]] = []  # pieces of closed groups, then of the open one
        size = begin = inside = 0  # bytes held, where the open group begins and its bytes
        open_group = None
        seen: dict[bytes, int] = {}

        def give(pieces: list[tuple[int, int, bytes]]) -> Iterator[pd.DataFrame]:
            if len(pieces) > 1:
                keys, firsts, data = zip(*pieces)
                key, first, last = repeats_in(np.array(keys, np.int64), np.array(firsts, np.int64), list(data), length)
                yield pd.DataFrame({"key": key, "first": first, "last": last})

        for batch in batches:
            copies = []
            for group, key, first, data in zip(batch["group"].tolist(), batch["key"].tolist(), batch["first"].tolist(), batch["data"]):
                if group != open_group:
                    if len(held) - begin == 1:  # nothing to compare
                        size -= len(held.pop()[2])
                    if size >= ARRAY_BYTES:
                        yield from give(held)
                        held, size = [], 0
                    open_group, begin, inside = group, len(held), 0
                    seen.clear()
                n = seen.get(data, 0)
                if n < 2:
                    seen[data] = n + 1
                    held.append((key, first, data))
                    size += len(data)
                    inside += len(data)
                    if group & 1 and inside >= ARRAY_BYTES and len(held) - begin > 2:
                        yield from give(held)
                        held = [held[begin]]  # the place stays for the rest of the group
                        begin, size = 0, len(held[0][2])
                        inside = size
                        seen = {x: n for x, n in seen.items() if n > 1}
                else:
                    copies.append((key, first, first + len(data) - length))
            if copies:
                yield pd.DataFrame(copies, columns=["key", "first", "last"])
        if len(held) - begin == 1:
            held.pop()
        yield from give(held)

    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch["text"], batch["ranges"]):
                data = np.frombuffer(text.encode(), np.uint8)
                gone = np.zeros(len(data), bool)
                for r in ranges if ranges is not None else ():
                    gone[r["first"] : r["last"] + length] = True
                kept = data[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            frame = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame

    return run


def repeated_ranges(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """``docs`` as ``(key, text)``, and ``(key, ranges)``: windows that start earlier elsewhere.

    Both joins deal out these same two columns by key, so the texts are shuffled once and the exchange is used again.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(_read(length), _FOUND)
    found = found.repartition(n, "h").sortWithinPartitions("h", "c", "key", "place")
    met = cut(found.mapInPandas(_meet, ", ".join(f"{c} long" for c in _MET)))
    claims = met.where("shape < 0").select("key", "first", "last", "lead", "at").repartition(n, "key").sortWithinPartitions("key", "lead", F.col("first") - F.col("at"), "first")
    claims = cut(claims.mapInPandas(_claims, "key long, first long, last long, lead long, at long"))
    group = F.xxhash64("lead", "at", F.col("last") - F.col("first")).bitwiseOR(F.lit(1))
    place = lambda key, first, last, g, shape: (F.col(key).alias("key"), first.cast("int").alias("first"), last.cast("int").alias("last"), g.alias("group"), F.lit(shape).cast("int").alias("shape") if isinstance(shape, int) else shape.cast("int").alias("shape"))
    own = claims.select(*place("key", F.col("first"), F.col("last"), group, -1))
    led = claims.select(*place("lead", F.col("at"), F.col("at") + F.col("last") - F.col("first"), group, -1)).distinct()
    compare = met.where("shape >= 0").select(*place("key", F.col("first"), F.lit(0), F.lit(0).cast("long"), F.col("shape")))
    wanted = own.unionByName(led).unionByName(compare).groupBy("key").agg(F.collect_list(F.struct("first", "last", "group", "shape")).alias("places"))
    contexts = rows.join(wanted, "key").select("key", "text", "places").mapInPandas(_contexts(length), "group long, key long, first long, data binary")
    contexts = contexts.repartition(n, "group").sortWithinPartitions("group", "key", "first")
    ranges = contexts.mapInPandas(_arrays(length), "key long, first long, last long")
    return rows, ranges.groupBy("key").agg(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = 100, texts: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, and ``kept``, the text left, if ``texts``.

    Removed is every byte that lies in a string of ``length`` bytes which also starts earlier: in a document of smaller id, or
    in the same document; rows without an id come first.  Null is the empty text.  Rows that repeat an id are one document:
    each loses what any of them loses.  A cut inside a character leaves U+FFFD in ``kept``; the digest is of the bytes.
    """
    rows, ranges = repeated_ranges(docs, length)
    out = map_frames(rows.join(ranges, "key", "left").select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "text", "ranges"), _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")
