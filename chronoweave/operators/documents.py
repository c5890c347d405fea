"""Whole documents as arrays: triangles, paths and their counts where a document's edges are, so that none of them is shuffled.

Edges ``(doc, s, t, rel)`` with ``kind`` go by document once and in order; a task holds the edges of some documents and parts of
their wedges.  What leaves it is an edge's sums, an edge's first paths or counts of labels, never a triangle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import vocabulary as V

#: Edges of whole documents that are read at a time, about, and wedges that are formed at a time.
BATCH_EDGES, BATCH_WEDGES = 100_000, 1_000_000


def by_document(edges: DataFrame, *more: str) -> DataFrame:
    """``(doc, s, t, kind, rel, more...)`` without null keys, documents whole and in order."""
    kind = F.coalesce("kind", F.lit("EE")) if "kind" in edges.columns else F.lit("EE")
    rows = edges.where(F.col("doc").isNotNull() & F.col("s").isNotNull() & F.col("t").isNotNull()).select("doc", "s", "t", kind.alias("kind"), "rel", *more)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(n, "doc").sortWithinPartitions("doc", "s", "t")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in parts of whole documents."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < BATCH_EDGES:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        at = pc.index(rows["doc"], rows["doc"][len(rows) - 1]).as_py()
        if at:
            yield rows.slice(0, at)
        held, n = rows.slice(at).to_batches(), len(rows) - at if at else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def expand(start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places from ``start`` on, ``many`` of them: the row of each place, and the place."""
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) + np.repeat(start - np.cumsum(many) + many, many)


def pieces(work: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows whose work comes to about ``most``."""
    part = np.cumsum(work) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(work)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield slice(int(a), int(b))


def rank(key: np.ndarray) -> np.ndarray:
    """Place of each row among those of its key, in the rows' order."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return out


class Graph:
    """Edges of some whole documents: nodes numbered in order by document, labels and the letters of kinds as codes."""

    def __init__(self, rows: pa.Table):
        self.rows, n = rows, len(rows)
        doc = rows["doc"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        values = pa.concat_arrays([rows["s"].combine_chunks(), rows["t"].combine_chunks()])
        if pa.types.is_integer(values.type):
            _, node = np.unique(values.to_numpy(), return_inverse=True)
        else:
            node = pd.factorize(values.to_pandas(), sort=True)[0]
        _, self.at, number = np.unique(np.tile(doc, 2) * (2 * n + 1) + node, return_index=True, return_inverse=True)
        self.values, self.nodes = values, len(self.at)
        self.doc, self.s, self.t = doc, number[:n], number[n:]
        code = rows["rel"].combine_chunks().dictionary_encode()
        said = code.dictionary.to_pylist()
        back = [r if r in V.SYMMETRIC else r[1:] if r.startswith("i") else f"i{r}" for r in said]
        self.names = [*sorted({*said, *back}), None]
        index = {r: i for i, r in enumerate(self.names)}
        at = pc.fill_null(code.indices, len(said)).to_numpy()
        self.label = np.array([*(index[r] for r in said), len(self.names) - 1])[at]
        self.label_back = np.array([*(index[r] for r in back), len(self.names) - 1])[at]
        self.backwards = np.array([index.get(r if r in V.SYMMETRIC else r[1:] if r.startswith("i") else f"i{r}", len(index) - 1) for r in self.names[:-1]] + [len(index) - 1])
        kind = rows["kind"].combine_chunks().dictionary_encode()
        kinds = kind.dictionary.to_pylist()
        self.letters = sorted({x for k in kinds for x in k[:2]})
        ends = np.array([[self.letters.index(x) for x in k[:2]] for k in kinds]).reshape(-1, 2)[kind.indices.to_numpy()]
        self.kind, self.kinds, self.k_s, self.k_t = kind.indices.to_numpy().astype(np.int64), kinds, ends[:, 0], ends[:, 1]

    def value(self, nodes: np.ndarray) -> pa.Array:
        return self.values.take(pa.array(self.at[nodes]))

    def name(self, labels: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(labels))

    # -------------------------------------------------------------- triangles

    def triangles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers of the edges xy, yz and xz of all triangles x < y < z, some of them at a time; repeated edges count each."""
        self.back = self.s > self.t
        self.lo, self.hi = np.minimum(self.s, self.t), np.maximum(self.s, self.t)
        self.o = np.where(self.back, self.label_back, self.label)
        self.k_lo, self.k_hi = np.where(self.back, self.k_t, self.k_s), np.where(self.back, self.k_s, self.k_t)
        key = self.lo * self.nodes + self.hi
        order = np.argsort(key, kind="stable")
        order = order[self.lo[order] < self.hi[order]]
        keys, starts = key[order], self.lo[order]
        after = np.searchsorted(keys, keys, side="right")
        many = np.searchsorted(starts, starts, side="right") - after
        for part in pieces(many, BATCH_WEDGES):
            xy, xz = expand(after[part], many[part])
            xy = xy + part.start
            wanted = self.hi[order[xy]] * self.nodes + self.hi[order[xz]]
            first = np.searchsorted(keys, wanted)
            row, yz = expand(first, np.searchsorted(keys, wanted, side="right") - first)
            if len(row):
                yield order[xy[row]], order[yz], order[xz[row]]

    def configurations(self, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Letters and oriented labels of triangles, the group of their document, and how many have them."""
        n, k = len(self.names), len(self.letters)
        found: dict[int, int] = {}
        for xy, yz, xz in self.triangles():
            code = (self.k_lo[xy] * k + self.k_hi[xy]) * k + self.k_hi[yz]
            code = ((code * n + self.o[xy]) * n + self.o[yz]) * n + self.o[xz]
            if group is not None:
                code = code + group[xy] * (k * n) ** 3
            for c, m in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                found[c] = found.get(c, 0) + m
        code, many = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
        out = []
        for size in (n, n, n, k, k, k):
            out.append(code % size)
            code = code // size
        return (*out[::-1], code, many)

    # ------------------------------------------------------------------ paths

    def close(self) -> None:
        """Each edge in both directions, by its first node and then its second."""
        u, v = np.concatenate([self.s, self.t]), np.concatenate([self.t, self.s])
        order = np.lexsort((v, u))
        self.v = v[order]
        self.o_uv = np.concatenate([self.label, self.label_back])[order]
        self.k_v = np.concatenate([self.k_t, self.k_s])[order]
        self.keys = u[order] * self.nodes + self.v
        self.begin = np.searchsorted(u[order], np.arange(self.nodes + 1))
        self.degree = np.diff(self.begin)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges once for each end pair and kind, by their end, and how often each occurs."""
        order = np.lexsort((self.kind, self.s, self.t))
        same = (np.diff(self.s[order]) == 0) & (np.diff(self.t[order]) == 0) & (np.diff(self.kind[order]) == 0)
        first = np.flatnonzero(np.append(True, ~same))
        return order[first], np.diff(np.append(first, len(order)))

    def two_hops(self, edges: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``(edge, m, k_m, o1, o2)`` of the paths of two edges, by edge and m."""
        for part in pieces(self.degree[self.s[edges]], BATCH_WEDGES):
            some = edges[part]
            row, at = expand(self.begin[self.s[some]], self.degree[self.s[some]])
            wanted = self.v[at] * self.nodes + self.t[some[row]]
            first = np.searchsorted(self.keys, wanted)
            hit, to = expand(first, np.searchsorted(self.keys, wanted, side="right") - first)
            yield row[hit] + part.start, self.v[at[hit]], self.k_v[at[hit]], self.o_uv[at[hit]], self.o_uv[to]

    def ends_of(self, t: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(t, m, y, k_y, o2, o3)`` of the last two edges of all paths m, y, t that end in the nodes t, by t, y and m."""
        row, at = expand(self.begin[t], self.degree[t])
        at = at[self.v[at] != t[row]] if (self.v[at] == t[row]).any() else at
        end = self.keys[at] // self.nodes
        y = self.v[at]
        row, to = expand(self.begin[y], self.degree[y])
        keep = self.v[to] != end[row]
        row, to = row[keep], to[keep]
        return end[row], self.v[to], y[row], self.k_v[at[row]], self.backwards[self.o_uv[to]], self.backwards[self.o_uv[at[row]]]

    def by_end(self, edges: np.ndarray) -> Iterator[np.ndarray]:
        """Some edges at a time, all of an end together.  ``edges`` are in order by their end."""
        ends, first = np.unique(self.t[edges], return_index=True)
        row, at = expand(self.begin[ends], self.degree[ends])
        work = np.bincount(row, self.degree[self.v[at]], len(ends)) + 1
        cuts = np.append(first, len(edges))
        for part in pieces(work.astype(np.int64), BATCH_WEDGES):
            yield np.arange(cuts[part.start], cuts[part.stop])


#: What a kernel makes of some whole documents.
Kernel = Callable[[Graph], Iterator[pa.RecordBatch]]


def run(edges: DataFrame, kernel: Kernel, schema: str, *more: str) -> DataFrame:
    """The batches that ``kernel`` makes of all documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches):
            yield from kernel(Graph(rows))

    return by_document(edges, *more).mapInArrow(each, schema)


def key_types(edges: DataFrame) -> str:
    types = dict(edges.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in ("doc", "s", "t"))


def configuration_counts(edges: DataFrame, group: str | None = None) -> DataFrame:
    """``(kinds, o_xy, o_yz, o_xz, n)`` of all triangles, with ``group``, a whole number of each document, if it is named."""

    def kernel(g: Graph) -> Iterator[pa.RecordBatch]:
        values, code = (None, None) if group is None else np.unique(g.rows[group].to_numpy(), return_inverse=True)
        a, b, c, xy, yz, xz, which, many = g.configurations(code)
        letters = np.array(g.letters, object)
        out = [pa.array(letters[a] + letters[b] + letters[c], pa.string()) if len(a) else pa.array([], pa.string()), g.name(xy), g.name(yz), g.name(xz), pa.array(many)]
        names = ["kinds", "o_xy", "o_yz", "o_xz", "n"]
        if group is not None:
            out, names = [*out, pa.array(values[which].astype(np.int64))], [*names, group]
        yield pa.RecordBatch.from_arrays(out, names=names)

    extra = [] if group is None else [group]
    found = run(edges, kernel, ", ".join(["kinds string, o_xy string, o_yz string, o_xz string, n long", *(f"{c} long" for c in extra)]), *extra)
    return found.groupBy("kinds", "o_xy", "o_yz", "o_xz", *extra).agg(F.sum("n").alias("n")).select("kinds", "o_xy", "o_yz", "o_xz", *extra, "n")


def _first(key: np.ndarray, times: np.ndarray, most: int) -> np.ndarray:
    """Rows among the first ``most`` of their key, a row of a repeated edge as often as that edge."""
    if times.max(initial=1) == 1:
        return np.flatnonzero(rank(key) < most)
    every = np.repeat(np.arange(len(key)), times)
    return every[rank(key[every]) < most]


def two_hop(edges: DataFrame, most: int) -> DataFrame:
    """``(doc, s, t, family, m, o1, o2)``: the first ``most`` nodes m between an edge's ends in each family."""

    def kernel(g: Graph) -> Iterator[pa.RecordBatch]:
        g.close()
        pairs, times = g.pairs()
        k = len(g.letters)
        families = pa.array([f"{kind}3{x}" for kind in g.kinds for x in g.letters])
        for row, m, km, o1, o2 in g.two_hops(pairs):
            keep = _first(row * k + km, times[row], most)
            e = pairs[row[keep]]
            yield pa.RecordBatch.from_arrays([*(g.rows[c].combine_chunks().take(pa.array(e)) for c in ("doc", "s", "t")), families.take(pa.array(g.kind[e] * k + km[keep])), g.value(m[keep]), g.name(o1[keep]), g.name(o2[keep])], names=["doc", "s", "t", "family", "m", "o1", "o2"])

    return run(edges, kernel, f"{key_types(edges)}, family string, m {dict(edges.dtypes)['s']}, o1 string, o2 string")


def three_hop(edges: DataFrame, most: int) -> DataFrame:
    """``(doc, s, t, family, m, y, o1, o2, o3)``: the first ``most`` paths s, m, y, t in each family, by m and then y.

    Of the nodes y between m and t only ``most`` of a kind and one more (for y = s) can be in an edge's first paths.
    """

    def kernel(g: Graph) -> Iterator[pa.RecordBatch]:
        g.close()
        pairs, times = g.pairs()
        k = len(g.letters)
        families = pa.array([f"{kind}4{x}{y}" for kind in g.kinds for x in g.letters for y in g.letters])
        for part in g.by_end(pairs):
            some = pairs[part]
            t, m, y, ky, o2, o3 = g.ends_of(np.unique(g.t[some]))
            key = (t * g.nodes + m) * k + ky
            order = np.argsort(key, kind="stable")  # by y within a key
            key = key[order]
            copies = 1 if len(g.keys) < 2 or (np.diff(g.keys) != 0).all() else len(g.rows)  # with repeated edges a node y may be there more than once
            keep = rank(key) < (most + 1 if copies == 1 else len(key) + 1)
            order, key = order[keep], key[keep]
            y, o2, o3 = y[order], o2[order], o3[order]
            row, at = expand(g.begin[g.s[some]], g.degree[g.s[some]])
            s, end, m = g.s[some[row]], g.t[some[row]], g.v[at]
            usable = m != end
            row, at, s, end, m = row[usable], at[usable], s[usable], end[usable], m[usable]
            wanted = ((end * g.nodes + m) * k)[:, None] + np.arange(k)
            first = np.searchsorted(key, wanted)
            many = np.searchsorted(key, wanted, side="right") - first
            # by edge and family in the order of m; nodes m after enough paths are not looked at
            flat = ((row * k + g.k_v[at])[:, None] * k + np.arange(k)).ravel()
            which = np.argsort(flat, kind="stable")
            flat, n = flat[which], many.ravel()[which]
            which, flat, n = which[n > 0], flat[n > 0], n[n > 0]
            if not len(flat):
                continue
            sure = n - 1 if copies == 1 else np.zeros(len(n), np.int64)
            before = np.cumsum(sure) - sure
            head = np.flatnonzero(np.append(True, np.diff(flat) != 0))
            before = before - np.repeat(before[head], np.diff(np.append(head, len(flat))))
            look = before < most
            which, flat, n = which[look], flat[look], n[look]
            hop, place = expand(first.ravel()[which], n)
            good = y[place] != s[which[hop] // k]
            hop, place = hop[good], place[good]
            got = _first(flat[hop], times[part][row[which[hop] // k]], most)
            hop, place = hop[got], place[got]
            one = which[hop] // k
            e = some[row[one]]
            family = families.take(pa.array(g.kind[e] * k * k + flat[hop] % (k * k)))
            for a in range(0, len(e), 200_000):
                x = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [*(g.rows[c].combine_chunks().take(pa.array(e[x])) for c in ("doc", "s", "t")), family[x], g.value(m[one[x]]), g.value(y[place[x]]), g.name(g.o_uv[at[one[x]]]), g.name(o2[place[x]]), g.name(o3[place[x]])],
                    names=["doc", "s", "t", "family", "m", "y", "o1", "o2", "o3"],
                )

    node = dict(edges.dtypes)["s"]
    return run(edges, kernel, f"{key_types(edges)}, family string, m {node}, y {node}, o1 string, o2 string, o3 string")


def motif_atoms(edges: DataFrame, most: int, *more: str) -> DataFrame:
    """``edges`` with ``atoms``, the labels along the first paths of two edges between their ends with their family, each once."""

    def kernel(g: Graph) -> Iterator[pa.RecordBatch]:
        g.close()
        pairs, times = g.pairs()
        k, n = len(g.letters), len(g.names)
        owners, codes = [], []
        for row, _, km, o1, o2 in g.two_hops(pairs):
            keep = _first(row * k + km, times[row], most)
            code = np.unique(row[keep] * (k * n * n) + (km[keep] * n + o1[keep]) * n + o2[keep])
            owners.append(code // (k * n * n))
            codes.append(code % (k * n * n))
        owner, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, codes))
        many = np.bincount(owner, minlength=len(pairs))
        # every edge has what its pair and kind have
        order = np.lexsort((g.kind, g.s, g.t))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.repeat(np.arange(len(pairs)), times)
        _, place = expand((np.cumsum(many) - many)[pair], many[pair])
        used, inverse = np.unique(np.repeat(g.kind, many[pair]) * (k * n * n) + code[place], return_inverse=True)
        text = [f"GRAPH|{g.kinds[c // (k * n * n)]}3{g.letters[c // (n * n) % k]}|" + ">".join(x for x in (g.names[c // n % n], g.names[c % n]) if x is not None) for c in used.tolist()]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many[pair])), pa.int32()), pa.array(text, pa.string()).take(pa.array(inverse)))
        yield pa.RecordBatch.from_arrays([*(g.rows[c].combine_chunks() for c in names), lists], names=[*names, "atoms"])

    names = ["doc", "s", "t", "kind", "rel", *more]
    types = dict(edges.dtypes) | {"kind": "string"}
    return run(edges, kernel, ", ".join([*(f"{c} {types[c]}" for c in names), "atoms array<string>"]), *more)


def path_atom_counts(edges: DataFrame) -> DataFrame:
    """``(atom, n)``: edges whose ends all paths of two and of three hops join with these labels and kinds; no path is left out.

    Paths of three hops are not formed one by one: those that share m, t, the kind of y and both last labels count as one, with
    the first and the last of their nodes y, which tell whether a y other than the edge's start is among them.
    """

    def kernel(g: Graph) -> Iterator[pa.RecordBatch]:
        g.close()
        pairs, _ = g.pairs()
        k, n = len(g.letters), len(g.names)
        two, three = k * n * n, k * k * n**3
        found: dict[str, int] = {}

        def count(edges_: np.ndarray, codes: Iterator[tuple[np.ndarray, np.ndarray]], width: int, name: Callable[[int], str]) -> None:
            """Adds edges by kind and code.  Rows are ``(edge, code)``; an edge counts once for a code."""
            for edge, code in codes:
                once = np.unique(edge * width + code)
                kinds = g.kind[edges_[once // width]]
                for c, m in zip(*(x.tolist() for x in np.unique(kinds * width + once % width, return_counts=True))):
                    atom = f"GRAPH|{g.kinds[c // width]}{name(c % width)}"
                    found[atom] = found.get(atom, 0) + m

        path = lambda *labels: ">".join(x for x in (g.names[i] for i in labels) if x is not None)
        count(pairs, ((row, (km * n + o1) * n + o2) for row, _, km, o1, o2 in g.two_hops(pairs)), two, lambda c: f"3{g.letters[c // (n * n)]}|{path(c // n % n, c % n)}")

        def long_paths() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in g.by_end(pairs):
                some = pairs[part]
                t, m, y, ky, o2, o3 = g.ends_of(np.unique(g.t[some]))
                if not len(t):
                    continue
                key = ((t * g.nodes + m) * k + ky) * (n * n) + o2 * n + o3
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.append(True, np.diff(key) != 0))
                least, largest, key = y[order[first]], y[order[np.append(first[1:], len(key)) - 1]], key[first]
                near = key // (k * n * n)
                for cut in pieces(g.degree[g.s[some]], BATCH_WEDGES // 4):
                    piece = some[cut]
                    row, at = expand(g.begin[g.s[piece]], g.degree[g.s[piece]])
                    usable = g.v[at] != g.t[piece[row]]
                    row, at = row[usable], at[usable]
                    wanted = g.t[piece[row]] * g.nodes + g.v[at]
                    start = np.searchsorted(near, wanted)
                    hop, place = expand(start, np.searchsorted(near, wanted, side="right") - start)
                    s = g.s[piece[row[hop]]]
                    good = (least[place] != s) | (largest[place] != s)
                    hop, place = hop[good], place[good]
                    rest = key[place] % (k * n * n)
                    code = ((g.k_v[at[hop]] * k + rest // (n * n)) * n + g.o_uv[at[hop]]) * (n * n) + rest % (n * n)
                    yield part[cut][row[hop]], code

        count(pairs, long_paths(), three, lambda c: f"4{g.letters[c // (k * n**3)]}{g.letters[c // n**3 % k]}|{path(c // n**2 % n, c // n % n, c % n)}")
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["atom", "n"])

    return run(edges, kernel, "atom string, n long").groupBy("atom").agg(F.sum("n").alias("n"))


def edge_states(edges: DataFrame, bad: list[tuple[str, str, str]], *more: str) -> DataFrame:
    """``(doc, s, t, kind, rel, more..., bad)``: 1 for edges in a triangle of labels ``(o_xy, o_yz, o_xz)`` of ``bad``, 0 in others alone, null in none."""

    def kernel(g: Graph) -> Iterator[pa.RecordBatch]:
        n, index = len(g.names), {r: i for i, r in enumerate(g.names)}
        table = np.zeros((n, n, n), bool)
        for names in bad:
            if all(x in index for x in names):
                table[tuple(index[x] for x in names)] = True
        state = np.full(len(g.rows), -1, np.int64)
        for three in g.triangles():
            wrong = table[tuple(g.o[e] for e in three)]
            for e in three:
                state[e] = np.maximum(state[e], 0)
            for e in three:
                state[e[wrong]] = 1
        yield pa.RecordBatch.from_arrays([*(g.rows[c].combine_chunks() for c in names_), pa.array(state, mask=state < 0)], names=[*names_, "bad"])

    names_ = ["doc", "s", "t", "kind", "rel", *more]
    types = dict(edges.dtypes) | {"kind": "string"}
    return run(edges, kernel, ", ".join([*(f"{c} {types[c]}" for c in names_), "bad long"]), *more)


def labels_of_pairs(edges: DataFrame) -> DataFrame:
    """``(doc, s, t, n)``: ordered pairs and how many different labels they have."""

    def kernel(g: Graph) -> Iterator[pa.RecordBatch]:
        pair = g.s * g.nodes + g.t
        _, first, pair = np.unique(pair, return_index=True, return_inverse=True)
        known = g.label < len(g.names) - 1
        once = np.unique(pair[known] * len(g.names) + g.label[known])
        many = np.bincount(once // len(g.names), minlength=len(first))
        yield pa.RecordBatch.from_arrays([*(g.rows[c].combine_chunks().take(pa.array(first)) for c in ("doc", "s", "t")), pa.array(many.astype(np.int64))], names=["doc", "s", "t", "n"])

    return run(edges, kernel, f"{key_types(edges)}, n long")


def with_opposite(edges: DataFrame) -> DataFrame:
    """``(doc, s, t, rel, opposite)``: edges and whether their document has one from t to s."""

    def kernel(g: Graph) -> Iterator[pa.RecordBatch]:
        opposite = np.isin(g.t * g.nodes + g.s, g.s * g.nodes + g.t)
        yield pa.RecordBatch.from_arrays([*(g.rows[c].combine_chunks() for c in ("doc", "s", "t", "rel")), pa.array(opposite)], names=["doc", "s", "t", "rel", "opposite"])

    return run(edges, kernel, f"{key_types(edges)}, rel string, opposite boolean")
