"""Secret scanning: fixed patterns, then two character Markov models compared by log-likelihood ratio (operator 2)."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.common import map_frames

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Every match of access and hex, and every candidate, lies in such a run.
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

# Parts from which the default sample of ordinary identifiers is made.
_PARTS = (
    "get set user name index value count table column row data file path list item type node edge graph event time stamp start end next prev"
    " is has make build read write parse format string number buffer stream request response handler manager service client server config"
    " option default update delete insert select order group filter window join merge split token error message result status state cache"
    " the and that with from this have their would about which there people because through between government information development"
    " tion ment ness able ing ers ation ering ation ously ement heit keit lich ung schaft ation eaux ique ement ación miento idad"
).split()


def ordinary_identifiers(n: int, seed: int = 11) -> list[str]:
    """Identifiers as programs and prose have them: joined words, snake, kebab, camel and upper case, paths, dates."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rnd.choice(_PARTS) for _ in range(rnd.randint(2, 6))]
        kind = rnd.randrange(9)
        if kind < 3:
            out.append("".join(parts))
        elif kind == 3:
            out.append("_".join(parts))
        elif kind == 4:
            out.append("-".join(parts))
        elif kind == 5:
            out.append(parts[0] + "".join(p.capitalize() for p in parts[1:]))
        elif kind == 6:
            out.append("_".join(parts).upper())
        elif kind == 7:
            out.append("/".join(parts) + f"/{rnd.randint(1, 2030)}")
        else:
            out.append(f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}-" + "-".join(parts))
    return out


def random_strings(n: int, seed: int = 12) -> list[str]:
    """Keys as generators make them: base64, base64url, letters and digits, upper case and digits, hexadecimal."""
    rnd = random.Random(seed)
    letters, digits = ALPHABET[:52], "0123456789"
    sets = (letters + digits + "+/", letters + digits + "-_", letters + digits, letters[26:] + digits, digits + "abcdef", letters[:26] + digits)
    return ["".join(rnd.choices(sets[i % len(sets)], k=rnd.randint(16, 64))) for i in range(n)]


class Markov:
    """First-order chain over ``ALPHABET`` with a start state, additive smoothing; other characters are one state."""

    def __init__(self, samples: Iterable[str], smoothing: float = 0.5):
        counts: dict[str, float] = {}
        totals: dict[str, float] = {}
        for sample in samples:
            for a, b in zip("\x00" + sample, sample):
                counts[a + b] = counts.get(a + b, 0) + 1
                totals[a] = totals.get(a, 0) + 1
        states = "\x00" + ALPHABET
        self.log = {a + b: math.log((counts.get(a + b, 0) + smoothing) / (totals.get(a, 0) + smoothing * len(ALPHABET))) for a, b in product(states, ALPHABET)}
        self.other = math.log(1 / len(ALPHABET))


class SecretModel:
    """Log-likelihood ratio of the random and the ordinary chain, fitted on labelled samples ``(string, is_secret)``."""

    def __init__(self, samples: Iterable[tuple[str, bool]]):
        samples = list(samples)
        secret, ordinary = Markov(s for s, y in samples if y), Markov(s for s, y in samples if not y)
        self.ratio = {pair: secret.log[pair] - ordinary.log[pair] for pair in secret.log}

    def score(self, string: str) -> float:
        ratio = self.ratio
        return sum(ratio.get(a + b, 0.0) for a, b in zip("\x00" + string, string))

    def is_secret(self, string: str, per_char: float = 0.75, least: float = 14.0) -> bool:
        """Long evidence and dense evidence: a total of ``least`` nats and ``per_char`` nats a character."""
        total = self.score(string)
        return total >= least and total >= per_char * len(string)


@lru_cache(maxsize=1)
def default_model() -> SecretModel:
    return SecretModel([*((s, True) for s in random_strings(6000)), *((s, False) for s in ordinary_identifiers(6000))])


def scan(text: str | None, model: SecretModel | None = None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then by kind; null is the empty text.

    The base kinds are leftmost matches without overlap per kind, short ones dropped afterwards.  ``markov`` adds each
    candidate string that the models hold for random and that shares no character with a base span.
    """
    if not text:
        return []
    model = model or default_model()
    base: list[tuple[int, int, int]] = []
    if ("=" in text or ":" in text) and any(w in (low := text.lower()) for w in _ASSIGN_WORDS):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    added: list[tuple[int, int, int]] = []
    for run in _RUN.finditer(text):
        a, b = run.span()
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= ACCESS_LEAST]
        if b - a >= HEX_LEAST:
            base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= HEX_LEAST]
        added += [(m.start(), 3, m.end()) for m in _CANDIDATE.finditer(text, a, b) if model.is_secret(m.group().strip("-_=./"))]
    free = [x for x in added if not any(s < x[2] and x[0] < e for s, _, e in base)] if base else added
    return [(KINDS[k], s, e) for s, k, e in sorted(base + free)]


def listed(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: Iterable[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """Each span, or union of spans that overlap, replaced by the mark of its first kind; an assignment's name stays."""
    out, at = [], 0
    for kind, s, e in spans:
        if kind == "assign":
            m = _ASSIGN.match(text, s, e)
            s = m.start(2) if m else s
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark.format(kind)]
        at = e
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov)``; rows without secrets have empty spans.

    Null and empty texts have no spans; repeated rows stay repeated; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = default_model()
        for batch in batches:
            found = [scan(t, model) for t in batch["text"]]
            base = [[x for x in spans if x[0] != "markov"] for spans in found]
            n = {f"n_{k}": [sum(x[0] == k for x in spans) for spans in found] for k in KINDS}
            yield pd.DataFrame({"doc_id": batch["doc_id"], **n, "base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b in base], "spans": [listed(s) for s in found]})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark and ``n_chars`` counted anew where a text changed.

    All rows and columns stay; a null text stays null.
    """

    at = {name: i for i, name in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = default_model()
        for batch in batches:
            texts = batch.column(at["text"]).to_pylist()
            new = [redact(t, spans) if t and (spans := scan(t, model)) else t for t in texts]
            columns = batch.columns
            columns[at["text"]] = pa.array(new, batch.schema.field(at["text"]).type)
            if "n_chars" in at:
                lengths = columns[at["n_chars"]].to_pylist()
                columns[at["n_chars"]] = pa.array([len(b) if b is not a else n for a, b, n in zip(texts, new, lengths)], batch.schema.field(at["n_chars"]).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
