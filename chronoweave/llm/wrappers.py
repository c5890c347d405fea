"""Main text of web pages by union-free wrappers (operator 1).

A page is a stream of block tags and texts.  Adjacent repeats in the stream are folded into repeated groups, which leaves few
distinct streams on a host.  The streams of a host are aligned one after the other into its wrapper, a regular expression
without unions: what only one side has becomes optional, an instance of a group joins the group, and texts that differ become
slots while texts that never differ stay part of the template.  A page's text is then read off its own stream: slots inside
the article, without template text and without the parts that the markup names as menus, notices, adverts and so on.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import cut, map_frames, partitions

# Element names and class words by what they are.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "math", "object", "canvas", "audio", "video")
BOILERPLATE = frozenset("head title nav footer aside form menu dialog button fieldset".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar"
    " aside nav navbar navigation menu topbar breadcrumb breadcrumbs pagination pager footer comment comments commentlist respond reply replies discussion disqus"
    " share sharing social related recommended newsletter subscribe signup login popup modal overlay widget toolbar masthead skip search".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
CONTENT = frozenset(("article", "main"))
#: Whose end tag may be left out: a new one of these ends the open one.
ENDED_BY = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div section article body main td".split())

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>]){_ATTRS}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRS})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: The longest run of symbols that is looked at as a group.
LONGEST_GROUP = 40
_REPEAT = re.compile(rf"(.{{1,{LONGEST_GROUP}}}?)\1+", re.S)

#: Pages of different texts that must share a text at a place of the wrapper before it counts as part of the template.
TEMPLATE_PAGES = 2


@dataclass
class Stream:
    symbols: list[str]  # block tags, and "#" for each text
    texts: list[str]
    roles: list[tuple[bool, bool]]  # per text: inside boilerplate, inside the article


@lru_cache(maxsize=20_000)
def _tag_kind(name: str, attrs: str) -> tuple[str, bool, bool]:
    """Symbol of an opening tag, whether markup names it boilerplate, whether it names it content."""
    marks = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _MARKS.finditer(attrs)} if attrs else {}
    words = [w for k in ("class", "id") for w in _SPLIT.split(marks.get(k, "")) if w]
    role = marks.get("role", "")
    content = name in CONTENT or role in ("main", "article")
    boiler = name in BOILERPLATE or role in BOILERPLATE_ROLES or not (content or name in ("body", "html")) and any(w in BOILERPLATE_WORDS for w in words)
    return f"<{name}{''.join('.' + w for w in words)}>", boiler, content


def read_stream(html: str | None) -> Stream:
    """Block stream of a page, however broken; null is the empty page."""
    symbols: list[str] = []
    texts: list[str] = []
    roles: list[tuple[bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    boiler = content = 0
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                symbols.append("#")
                texts.append(text)
                roles.append((boiler > 0, content > 0))

    def pop_to(depth: int) -> None:
        nonlocal boiler, content
        while len(stack) > depth:
            name, b, c = stack.pop()
            boiler -= b
            content -= c
            symbols.append(f"</{name}>")

    html = html or ""
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        closing, name, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            if m[1]:
                buffer.append(" ")
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if name == "br":
            buffer.append(" ")
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
            continue
        if name in VOID:
            symbols.append(f"<{name}>")
            continue
        if stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        if name in ENDED_BY:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ENDED_BY[name]:
                    pop_to(depth)
                    break
                if stack[depth][0] in SCOPE:
                    break
        symbol, b, c = _tag_kind(name, attrs)
        # a header outside the article is the site's, one inside is the article's own
        b = b or name == "header" and not content
        symbols.append(symbol)
        stack.append((name, b, c))
        boiler += b
        content += c
    buffer.append(html[at:])
    flush()
    pop_to(0)
    return Stream(symbols, texts, roles)


class _Letters(dict):
    """Symbols as single characters, so that repeats can be found in a string."""

    def __missing__(self, symbol: str) -> str:
        self[symbol] = c = chr(len(self) + 1 if len(self) < 0xD000 else len(self) + 0x1001)
        return c


def fold(symbols: list[str]) -> tuple[list[str], list[int | None]]:
    """Nodes of the stream with adjacent repeats as groups ``(...)+``, and for each text its node; None in a group."""
    letters = _Letters()
    line = "".join(map(letters.__getitem__, symbols))
    nodes: list[str] = []
    at: list[int | None] = []

    def plain(part: list[str]) -> None:
        for s in part:
            if s == "#":
                at.append(len(nodes))
            nodes.append(s)

    done = 0
    for m in _REPEAT.finditer(line):
        plain(symbols[done : m.start()])
        inner = symbols[m.start() : m.end(1)]
        nodes.append("(" + "".join(inner) + ")+")
        at += [None] * symbols[m.start() : m.end()].count("#")
        done = m.end()
    plain(symbols[done:])
    return nodes, at


@dataclass
class Node:
    """A place of a wrapper; ``text`` is the digest of the only text seen at a ``#``, None once texts differ."""

    key: str
    optional: bool = False
    text: str | None = None
    pages: int = 0

    def packed(self) -> list:
        return [self.key, self.optional, self.text, self.pages]


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


def _absorb(nodes: list[Node], groups: set[str]) -> list[Node]:
    """Single instances of known groups become the group."""
    for group in groups:
        inner = re.findall(r"<[^>]*>|#", group[1:-2])
        n, i, out = len(inner), 0, []
        while i < len(nodes):
            if nodes[i].key == inner[0] and [x.key for x in nodes[i : i + n]] == inner:
                if out and out[-1].key == group:
                    out[-1].optional &= all(x.optional for x in nodes[i : i + n])
                else:
                    out.append(Node(group, any(x.optional for x in nodes[i : i + n]), None, nodes[i].pages))
                i += n
            elif nodes[i].key == group and out and out[-1].key == group:
                i += 1
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The wrapper of both sides."""
    groups = {x.key for x in (*a, *b) if x.key[0] == "("}
    # longer groups first: what they take is no longer there for their parts
    ordered = sorted(groups, key=lambda g: (-len(g), g))
    for group in ordered:
        a, b = _absorb(a, {group}), _absorb(b, {group})
    out: list[Node] = []
    for op, i, j, k, m in SequenceMatcher(None, [x.key for x in a], [x.key for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [Node(x.key, x.optional or y.optional, x.text if x.text == y.text else None, x.pages + y.pages) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [Node(x.key, True, x.text, x.pages) for x in (*a[i:j], *b[k:m])]
    return out


def expression(wrapper: Iterable[Node]) -> str:
    """The wrapper as text: ``?`` marks optional places, ``#`` slots, ``=`` template texts."""
    return "".join(("=" if x.key == "#" and x.text else x.key) + ("?" if x.optional else "") for x in wrapper)


def page_nodes(stream: Stream) -> tuple[list[Node], list[int | None]]:
    keys, at = fold(stream.symbols)
    nodes = [Node(k, False, None, 1) for k in keys]
    for text, i in zip(stream.texts, at):
        if i is not None:
            nodes[i].text = _digest(text)
    return nodes, at


def _pack(nodes: list[Node]) -> str:
    return json.dumps([x.packed() for x in nodes], separators=(",", ":"))


def _unpack(packed: str) -> list[Node]:
    return [Node(*x) for x in json.loads(packed)]


def host_of(url) -> F.Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _merge_sorted(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """One wrapper for each run of equal keys in sorted rows ``(key..., skeleton, packed)``."""
    open_key, wrapper, last, count = None, None, None, 0
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            k = tuple(getattr(row, c) for c in key)
            nodes = _unpack(row.packed)
            if k != open_key:
                if wrapper is not None:
                    rows.append((*open_key, expression(wrapper), _pack(wrapper)))
                open_key, wrapper = k, nodes
            else:
                wrapper = align(wrapper, nodes)
        yield pd.DataFrame(rows, columns=[*key, "skeleton", "packed"])
    if wrapper is not None:
        yield pd.DataFrame([(*open_key, expression(wrapper), _pack(wrapper))], columns=[*key, "skeleton", "packed"])


def infer_wrappers(pages: DataFrame, salts: int = 8) -> DataFrame:
    """``(host, skeleton, packed)``: the wrapper of each host.

    Pages of equal stream are merged where they are read, so a large host sends few rows; what is left is aligned in salted
    parts and the parts in one step, in the order of the streams' text.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], list[Node]] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*k, _pack(v)) for k, v in seen.items()], columns=["host", "skeleton", "packed"])
            seen.clear()
            return out

        for batch in batches:
            for host, html in zip(batch["host"], batch["html"]):
                nodes, _ = page_nodes(read_stream(html))
                key = host, "".join(x.key for x in nodes)
                if (known := seen.get(key)) is None:
                    seen[key] = nodes
                else:
                    for x, y in zip(known, nodes):
                        x.pages += 1
                        if x.text != y.text:
                            x.text = None
            if len(seen) > 5_000:
                yield rows()
        yield rows()

    schema = "host string, skeleton string, packed string"
    spark = pages.sparkSession
    n = partitions(spark)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(texts=[_digest(json.dumps(read_stream(h).texts)) for h in batch["html"]])

    # copies of one page say nothing of the host: pages of equal texts count once
    distinct = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(digests, "host string, html string, texts string").dropDuplicates(["host", "texts"])
    streams = distinct.select("host", "html").mapInPandas(read, schema)
    salted = streams.withColumn("salt", F.pmod(F.xxhash64("skeleton"), F.lit(salts)).cast("int"))
    parts = salted.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "skeleton", "packed")
    parts = parts.mapInPandas(lambda it: _merge_sorted(it, ["host", "salt"]), "host string, salt int, skeleton string, packed string")
    whole = parts.repartition(n, "host").sortWithinPartitions("host", "salt")
    return whole.mapInPandas(lambda it: _merge_sorted(it, ["host"]), schema)


@lru_cache(maxsize=2_000)
def _template_places(packed: str, skeleton: tuple[str, ...]) -> dict[int, str]:
    """Places of a page's stream that hold template text, with its digest."""
    wrapper = _unpack(packed)
    template = sum(x.key == "#" and x.text is not None and x.pages >= TEMPLATE_PAGES for x in wrapper)
    slots = sum(x.key == "#" and x.text is None or x.key[0] == "(" and "#" in x.key for x in wrapper)
    if slots < template:  # the host's few pages are edited copies of one: what they share is no template
        return {}
    out = {}
    # the page's own positions: groups keep their place, so no instance is absorbed here
    matcher = SequenceMatcher(None, [x.key for x in wrapper], skeleton, autojunk=False)
    for i, k, n in matcher.get_matching_blocks():
        for d in range(n):
            x = wrapper[i + d]
            if x.key == "#" and x.text and x.pages >= TEMPLATE_PAGES:
                out[k + d] = x.text
    return out


def extract(html: str | None, packed: str | None = None) -> str:
    """Main text of a page, with its host's wrapper if there is one."""
    stream = read_stream(html)
    has_article = any(c and not b for b, c in stream.roles)
    template: dict[int, str] = {}
    at: list[int | None] = [None] * len(stream.texts)
    if packed:
        keys, at = fold(stream.symbols)
        template = _template_places(packed, tuple(keys))
    kept = []
    for text, (boiler, content), i in zip(stream.texts, stream.roles, at):
        if boiler or has_article and not content:
            continue
        # what the article's own markup holds stays, however many pages share it
        if not content and i is not None and i in template and template[i] == _digest(text):
            continue
        kept.append(text)
    return "\n".join(kept)


#: Wrappers of more bytes than this together are joined by host and not broadcast.
BROADCAST_BYTES = 32 << 20


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, host)`` of every page.

    A null html is the empty page and has an empty text; pages without a usable url share the empty host; a page that is all
    boilerplate has an empty text.  Repeated rows stay repeated, other columns are ignored.
    """
    wrappers = cut(infer_wrappers(pages).select("host", "packed"))
    size = wrappers.agg(F.coalesce(F.sum(F.length("packed")), F.lit(0)).alias("n")).first()["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(h, w) for h, w in zip(batch["html"], batch["packed"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": list(map(len, text)), "host": batch["host"]})

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")
    return map_frames(rows, run, "page_id long, url string, text string, n_chars long, host string")
