import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronoweave.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_equals_the_library():
    ours, lib = B.ByteBpe(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(5)
    letters = "abc ABC'stvmdl012  \n\t\x85\xa0\x1c\x1d éßñ²½٣中文🙂 ​́ʼ_"
    texts = ["", "<|endoftext|>", "a<|endoftext|>b", "ab" * 2000, "x" * 1500, "é" * 900, " " * 700]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    texts += ["".join(rnd.choice("aabcdething"[: rnd.randint(1, 11)]) for _ in range(rnd.randint(520, 2000))) for _ in range(40)]
    for text in texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_tree_of_any_leaf_size():
    ours = B.ByteBpe(PATH)
    text = "thequickbrownfoxjumps" * 60
    assert len({tuple(ours.encode_long(text, leaf)) for leaf in (1, 2, 3, 7, 50, 5000)}) == 1


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 5)
    assert B.ByteBpe(PATH).encode("one two three four five six seven") == Tokenizer.from_file(PATH).encode("one two three four five six seven", add_special_tokens=False).ids


def test_rows(odd_docs):
    got = {r["doc_id"]: r for r in B.digest_documents(odd_docs, PATH).collect()}
    assert len(got) == odd_docs.count() and got[0]["n_tokens"] == got[1]["n_tokens"] == 0
    assert got[7]["decoded_sha256"] == hashlib.sha256(b"a" * 5000).hexdigest()
    whole = B.encode_documents(odd_docs, PATH)
    assert {r["doc_id"]: r["n_tokens"] for r in whole.collect()} == {k: v["n_tokens"] for k, v in got.items()}
    back = {r["doc_id"]: r["decoded"] for r in B.decode_ids(whole, PATH).collect()}
    assert back[8] == "word " * 3000 and back[0] == ""
    assert B.digest_documents(odd_docs.limit(0), PATH).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        B.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_windows_grow(monkeypatch):
    """Joins that no window of one token settles: runs of one letter, and a long text without spaces."""
    ours, lib = B.ByteBpe(PATH), Tokenizer.from_file(PATH)
    calls = []
    monkeypatch.setattr(ours, "_batch", lambda pieces, real=ours._batch: calls.append(len(pieces)) or real(pieces))
    for text in ("=" * 20_000, "-" * 4097, "abcabd" * 3000, "é" * 9001, "nonunsplittablewords" * 700):
        calls.clear()
        assert ours.encode_long(text) == lib.encode(text, add_special_tokens=False).ids
        assert calls[0] == -(-len(text) // B.LEAF) and calls[1] == calls[0] // 2  # a level's leaves, then its joins, are one batch
