"""Rank rounds over blocks of edges, as functions for groups of Arrow rows.

A node that an edge points to has a place: its part in the upper 32 bits, its row there in the lower. A block holds edges:
plain ones, whose source has no place and all its edges in that block, and inner ones between places. Blocks and parts
keep what never changes; what moves are the values of the places that a block names and the sums that it has for them,
without keys, in the order of the block's list. Values of sources without a place never move: they follow from the places'
values of the round before, so their sums count a round later. All rows have the columns of ROWS.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

ROWS = "part long, block long, kind string, a binary, b binary, c binary"
MASSES = "no long, mass double"
#: Edges of a stored row, about; the edges of one source stay together.
CHUNK = 1 << 20


def _table(rows: Iterable[tuple]) -> pa.Table:
    part, block, kind, *data = zip(*rows) if (rows := list(rows)) else [()] * 6
    binary = [pa.array([None if x is None else memoryview(x if isinstance(x, pa.Buffer) else np.ascontiguousarray(x)).cast("B") for x in c], pa.binary()) for c in data]
    return pa.table([pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(kind, pa.string()), *binary], names=["part", "block", "kind", "a", "b", "c"])


def _masses(no: list, mass: list) -> pa.Table:
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return pa.table([join(no, np.int64), join(mass, np.float64)], names=["no", "mass"])


def _rows(table: pa.Table, kind: str) -> list[tuple]:
    """(part, block, a, b, c) of the rows of a kind, by part and block; the data is not copied."""
    found = [i for i, k in enumerate(table["kind"].to_pylist()) if k == kind]
    return sorted(((table["part"][i].as_py(), table["block"][i].as_py(), *(table[c][i].as_buffer() for c in "abc")) for i in found), key=lambda r: r[:2])


def _ints(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(data, np.int32)


def _doubles(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(data, np.float64)


def _lists(places: np.ndarray, counts: np.ndarray, first: np.ndarray, parts: list[int], block: int, kind: str) -> Iterable[tuple]:
    """A row for each part that a block's sorted places lie in: rows there, edges and first sums of each."""
    at = places >> 32
    for p in np.unique(at):
        x = slice(*np.searchsorted(at, [p, p + 1]))
        yield parts[p], block, kind + " list", (places[x] & 0xFFFFFFFF).astype(np.int32), counts[x].astype(np.float64), first[x]


def fold(parts: list[int]) -> Callable:
    """Edges (block, no, at, r, to) of whole blocks, sorted by no, as the rows and lists of each block; at and to are places, r is the source's restart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found = defaultdict(lambda: ([], []))  # nearly always one block
        for batch in batches:
            block, *rest = (batch.column(c).to_numpy() for c in ("block", "no", "at", "r", "to"))
            for key in np.unique(block):
                no, at, r, to = (c[block == key] for c in rest)
                free = at < 0
                own, heads = no[free], _heads(no[free])
                found[int(key)][0].append((own[heads], r[free][heads], np.diff(np.append(heads, len(own))), to[free]))
                found[int(key)][1].append((at[~free], to[~free]))
        for key in list(found):
            yield from _folded(key, *found.pop(key), parts)

    return run


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _folded(block: int, plain: list[tuple], inner: list[tuple], parts: list[int]) -> Iterable[pa.RecordBatch]:
    rows = lambda *r: _table(r).to_batches()
    no, r, degree, to = (np.concatenate(c) for c in zip(*plain))
    plain.clear()
    if len(to):
        heads = _heads(no)  # the edges of a source may have come in several batches
        no, r, degree = no[heads], r[heads], np.add.reduceat(degree, heads)
        ends = np.append(0, np.cumsum(degree))
        places = np.unique(to)
        counts, first = np.zeros(len(places), np.int64), np.zeros(len(places))
        cuts = np.unique(np.append(np.searchsorted(ends[:-1], np.arange(0, len(to), CHUNK)), len(no)))
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            at = np.searchsorted(places, to[ends[x] : ends[y]]).astype(np.int32)
            counts += np.bincount(at, minlength=len(places))
            first += np.bincount(at, np.repeat(r[x:y] / degree[x:y], degree[x:y]), len(places))
            yield from rows((i, block, "plain", degree[x:y].astype(np.int32), r[x:y], at), (i, block, "ids", no[x:y], None, None))
        yield from rows((None, block, "restart", r.sum(keepdims=True), None, None), *_lists(places, counts, first, parts, block, "plain"))
    a, b = (np.concatenate(c) for c in zip(*inner))
    inner.clear()
    if len(a):
        places, counts = np.unique(np.concatenate([a, b]), return_counts=True)
        yield from rows(*_lists(places, counts, np.zeros(len(places)), parts, block, "inner"))
        for i in range(0, len(a), CHUNK):
            yield from rows((i, block, "inner", *(np.searchsorted(places, x[i : i + CHUNK]).astype(np.int32) for x in (a, b)), None))


def own(key: tuple, nodes: pa.Table, lists: pa.Table) -> pa.Table:
    """Nodes (row, no, r) of one part and the lists that name them: the part's rows, and the first values and sums."""
    part, n = key[0].as_py(), nodes.num_rows
    order = np.argsort(nodes["row"].to_numpy())
    no, r = nodes["no"].to_numpy()[order], nodes["r"].to_numpy()[order]
    degree, later, out = np.zeros(n), np.zeros(n), []
    named = [(kind, *x) for kind in ("plain", "inner") for x in _rows(lists, kind + " list")]
    for _, _, _, at, counts, first in named:
        degree[_ints(at)] += _doubles(counts)
        later[_ints(at)] += _doubles(first)
    value = np.divide(r, degree, out=np.zeros(n), where=degree > 0)
    for kind, _, block, at, _, _ in named:
        out += [(part, block, kind + " list", at, None, None), (part, block, "first " + kind, value[_ints(at)], None, None)]
    out += [(part, None, "own", degree, r, no), (part, None, "restart", r[degree > 0].sum(keepdims=True), None, None)]
    return _table([*out, (part, -1 - part, "first later", later, None, None)])


def _sources(rows: list[tuple], values: np.ndarray, keep: float, again: float) -> Iterable[tuple]:
    """(chunk, mass, degree, to) of plain rows after a round."""
    for chunk, _, degree, r, to in rows:
        degree, to = _ints(degree), _ints(to)
        heads = np.cumsum(degree, dtype=np.int64) - degree
        yield chunk, keep * np.add.reduceat(values[to], heads) + _doubles(r) * again, degree, to


def _received(moved: pa.Table, kind: str) -> tuple[list[int], list[np.ndarray]]:
    got = _rows(moved, kind)
    return [x[0] for x in got], [_doubles(x[2]) for x in got]


def sums(keep: float, again: float) -> Callable:
    """What a block has for its places: inner edges for this round, plain ones for the next; `later` rows pass."""

    def run(key: tuple, block: pa.Table, moved: pa.Table) -> pa.Table:
        out = [(part, b, "later", a, None, None) for part, b, a, _, _ in _rows(moved, "later")]
        for kind in ("plain", "inner"):
            parts, values = _received(moved, kind)
            if not parts:
                continue
            splits, values = np.cumsum([len(v) for v in values])[:-1], np.concatenate(values)
            got, rows = np.zeros(len(values)), _rows(block, kind)
            if kind == "plain":
                for _, mass, degree, to in _sources(rows, values, keep, again):
                    got += np.bincount(to, np.repeat(mass / degree, degree), len(got))
            else:
                for _, _, a, b, _ in rows:
                    a, b = _ints(a), _ints(b)
                    got += np.bincount(a, values[b], len(got))
                    got += np.bincount(b, values[a], len(got))
            out += [(part, key[0].as_py(), kind, x, None, None) for part, x in zip(parts, np.split(got, splits))]
        return _table(out)

    return run


def source_masses(keep: float, again: float) -> Callable:
    """(no, mass) of a block's sources without a place after a round."""

    def run(_: tuple, block: pa.Table, moved: pa.Table) -> pa.Table:
        values, ids = _received(moved, "plain")[1], {x[0]: np.frombuffer(x[2], np.int64) for x in _rows(block, "ids")}
        found = [(ids[chunk], mass) for chunk, mass, _, _ in _sources(_rows(block, "plain"), np.concatenate(values) if values else np.zeros(0), keep, again)]
        return _masses([x for x, _ in found], [x for _, x in found])

    return run


def settle(keep: float, again: float, last: bool) -> Callable:
    """Sums that blocks have for one part: the values of its nodes for the next round; (no, mass) after the last."""

    def run(key: tuple, held: pa.Table, moved: pa.Table) -> pa.Table:
        part, (_, _, degree, r, no) = key[0].as_py(), _rows(held, "own")[0]
        degree, r = _doubles(degree), _doubles(r)
        got, later = np.zeros(len(r)), np.zeros(len(r))
        lists = {(kind, x[1]): _ints(x[2]) for kind in ("plain", "inner") for x in _rows(held, kind + " list")}
        for kind, into in (("plain", later), ("inner", got)):
            for _, block, x, _, _ in _rows(moved, kind):
                into[lists[kind, block]] += _doubles(x)
        for _, _, x, _, _ in _rows(moved, "later"):
            got += _doubles(x)
        mass = keep * got + r * again
        if last:
            return _masses([np.frombuffer(no, np.int64)[degree > 0]], [mass[degree > 0]])
        value = np.divide(mass, degree, out=np.zeros(len(r)), where=degree > 0)
        return _table([*((part, block, kind, value[at], None, None) for (kind, block), at in lists.items()), (part, -1 - part, "later", later, None, None)])

    return run
