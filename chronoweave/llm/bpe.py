"""Byte-level BPE encoding and decoding with a public vocabulary file (operator 6).

A text is cut by the vocabulary's own pre-tokenizer.  Short pieces are encoded once and remembered.  A long unsplit piece is
a tree of halves: its leaves are encoded in parallel, as one batch over the library's threads, then neighbours are
concatenated level by level.  At each join a window of tokens around the cut is encoded again and grows until its first and
last tokens are the ones that stood there before, on both sides; the windows of a level are again one parallel batch.  A sequence of tokens is the BPE encoding of its bytes exactly when each adjacent pair encodes
to itself; the two agreeing edge tokens keep the pairs outside the window, so an agreed join is exact and not a guess.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType
from tokenizers import Tokenizer

from chronoweave.llm.common import map_frames

#: A piece of more code points is encoded as a tree.
LONG = 512
#: Code points of a leaf.
LEAF = 128
#: Pieces of each of two generations that a worker remembers; the older one is dropped, which costs time and changes nothing.
REMEMBERED = 150_000

# The cutting pattern of byte-level vocabularies for texts below U+0250, where letters, numbers and white space are these.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stays, others start at U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library with a byte-level model.

    A file whose steps are others than byte-level ones (a normalizer, word ends, a cut of its own) is refused.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        step, model = file["pre_tokenizer"] or {}, file["model"]
        if file["normalizer"] or step.get("type") != "ByteLevel" or not step.get("use_regex", True) or step.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} has a model with options beyond plain BPE")
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has special tokens that take in their surroundings")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.uncut = Tokenizer(self.model)  # without a pre-tokenizer: a string is one piece
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {content: i for i, content in special.items()}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.bytes_of |= {i: content.encode() for i, content in special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.same = {i: i for i in self.bytes_of}  # one int object for each id
        self.split_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces of a text without special tokens."""
        if _BEYOND.search(text) is None:
            return _CUT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _raw(self, data: bytes) -> list[int]:
        """BPE of bytes, cut nowhere."""
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, data)))]

    def _batch(self, pieces: list[bytes]) -> list[list[int]]:
        """BPE of many byte strings, each cut nowhere, in the library's parallel threads."""
        return [e.ids for e in self.uncut.encode_batch(["".join(map(self.letters.__getitem__, p)) for p in pieces], add_special_tokens=False)]

    def join_all(self, level: list[list[int]]) -> list[list[int]]:
        """The encodings of each two encoded neighbours; an odd last one stays."""
        done = level[::2]
        size, still = 1, range(len(level) // 2)
        while still:
            windows = [(level[2 * i][-size:], level[2 * i + 1][:size]) for i in still]
            wider = []
            for i, (a, b), new in zip(still, windows, self._batch([b"".join(map(self.bytes_of.__getitem__, a + b)) for a, b in windows])):
                left, right = level[2 * i], level[2 * i + 1]
                agree_left = len(a) == len(left) or (new[0] == a[0] and len(new) > 1)
                agree_right = len(b) == len(right) or (new[-1] == b[-1] and len(new) > 1)
                if agree_left and agree_right:
                    done[i] = left[: len(left) - len(a)] + new + right[len(b) :]
                else:
                    wider.append(i)
            size, still = 2 * size, wider
        return done

    def encode_long(self, piece: str, leaf: int = LEAF) -> list[int]:
        """An unsplit piece of any length, as a tree of halves."""
        level = self._batch([piece[i : i + leaf].encode() for i in range(0, len(piece), leaf)])
        while len(level) > 1:
            level = self.join_all(level)
        return level[0] if level else []

    def _learn(self, pieces: list[str]) -> None:
        new = set(pieces).difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {}
            new = set(pieces)
        raw, same, older = self._raw, self.same.__getitem__, self.older
        self.known.update((p, older[p] if p in older else tuple(map(same, raw(p.encode()) if len(p) <= LONG else self.encode_long(p)))) for p in new)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; special tokens in it count as such.  Null is the empty text."""
        out: list[int] = []
        for part in self.split_special.split(text or "") if self.split_special else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                pieces = self.pieces(part)
                self._learn(pieces)
                out.extend(chain.from_iterable(map(self.known.__getitem__, pieces)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer_at(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)``: the ids of each row's whole text, and the digest of what they decode to.

    A null text is the empty text, which has no ids.  Repeated rows stay repeated and other columns are ignored.  ``path``
    is a place on every machine that has the vocabulary.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer_at(path)
        for batch in batches:
            for start in range(0, len(batch), 500):  # ids of a few texts at a time
                part = batch.iloc[start : start + 500]
                ids = [bpe.encode(t) for t in part["text"]]
                digests = [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_tokens": list(map(len, ids)), "ids": [np.array(i, np.int32) for i in ids], "decoded_sha256": digests})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``; null ids decode to the empty text."""

    rows = rows.drop("decoded")
    out = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    at, schema = rows.columns.index(ids), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer_at(path)
        for batch in batches:
            text = pa.array([bpe.decode(i or []) for i in batch.column(at).to_pylist()], schema.field("decoded").type)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, out)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``encode_documents``, digested where the ids are made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer_at(path)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = bpe.encode(text)
                listed = ",".join(map(bpe.decimal.__getitem__, ids))
                rows.append((len(ids), sha(listed.encode()).hexdigest(), sha(bpe.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": list(n), "ids_sha256": list(a), "decoded_sha256": list(b)})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
