"""Topic shares of (document, term) pairs, many documents at a time.

A document is a row of packed arrays: term numbers, counts and first topics. Terms are numbered by falling document
frequency. The shares of frequent terms are not kept: they follow from the sums by document and by term of all
rounds so far, of which there are few, and are iterated again from the start. So are those of a term of a single
document, whose sum by term is its own. Only the shares of the terms between them are stored with the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STATE = "ids binary, tf binary, own binary, lone binary, p binary, d binary, part int, w binary"
FIELDS = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.binary()) for f in STATE.split(", ")])
#: Pairs that are iterated together, unless one document has more.
CHUNK = 1 << 14
#: Pairs that are numbered together, unless one document has more.
CUT = 1 << 18
#: Sums by term are handed on in ranges of so many term numbers.
RANGE = 1 << 13
TOTALS, LONE = -1, -2  # parts that are no range: sums over all terms; terms of a single document, by their hash


def term_hash(term: bytes, salt: int) -> bytes:
    return md5(b"%d|" % salt + term).digest()[:8]


@dataclass(frozen=True)
class Terms:
    """Numbers of terms: ``hashes`` of those of several documents in order, ``number`` of each; ``left_out`` are in no vocabulary."""

    hashes: np.ndarray
    number: np.ndarray
    left_out: np.ndarray
    salt: int

    def codes(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each term, as many as there are numbers for a term of one document, -1 for none; and the hashes."""
        h = np.frombuffer(b"".join([term_hash(t, self.salt) for t in terms]), ">i8").astype(np.int64)
        many = len(self.hashes)
        place = np.minimum(np.searchsorted(self.hashes, h), max(many - 1, 0))
        out = np.full(len(h), many)
        if many:
            out = np.where(self.hashes[place] == h, self.number[place], many)
        return np.where(np.isin(h, self.left_out), -1, out), h


@dataclass(frozen=True)
class Sums:
    """What the rounds so far have left: sums by frequent term and over all of each round, by term of the last one."""

    frequent: tuple[np.ndarray, ...] = ()
    totals: tuple[np.ndarray, ...] = ()
    terms: np.ndarray | None = None


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array, each as its bytes; ``ends`` are their ends, after a zero."""
    at = pa.py_buffer((ends * data.itemsize).astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes in a row, and how many each row has."""
    column = column.fill_null(b"")
    many = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), many.astype(np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class Rounds:
    def __init__(self, k: int, start: float, size: int, shared: int, frequent: int, last: bool) -> None:
        """``size`` terms in all, ``shared`` of them in several documents, the first ``frequent`` of which are not stored."""
        self.k, self.size, self.shared, self.frequent, self.last = k, size, shared, min(frequent, shared), last
        self.even = (1 - start) / k
        self.high = start + self.even
        self.acc = np.zeros((k, shared))
        self.all = np.zeros(k)

    def _next(self, p: np.ndarray, d: np.ndarray, w: np.ndarray, total: np.ndarray) -> np.ndarray:
        prior = 1.0 / self.k
        u = d - p
        u += prior
        w -= p
        w += prior
        u *= w
        np.subtract((total + self.size * prior)[:, None], p, out=w)
        u /= w
        u /= u.sum(axis=0)
        return u

    def _add(self, ids: np.ndarray, weighted: np.ndarray) -> None:
        on = ids < self.shared
        ids = ids[on]
        for j in range(self.k):
            np.add.at(self.acc[j], ids, weighted[j, on])
        self.all += weighted.sum(axis=1)

    def _first(self, own: np.ndarray) -> np.ndarray:
        p = np.full((self.k, len(own)), self.even)
        p[own, np.arange(len(own))] = self.high
        return p

    def _so_far(self, ids, tf, own, doc, stored, history, sums: Sums) -> np.ndarray:
        """The shares after the rounds that ``history`` has."""
        p = self._first(own)
        rounds = history.shape[1]
        if not rounds:
            return p
        kept = (ids >= self.frequent) & (ids < self.shared)
        p[:, kept] = stored.T
        again = np.flatnonzero(~kept)
        q, tf, doc = p[:, again], tf[again], doc[again]
        lone = np.flatnonzero(ids[again] >= self.shared)
        at = np.minimum(ids[again], self.frequent)
        for s in range(rounds):
            w = sums.frequent[s].take(at, axis=1)
            w[:, lone] = tf[lone] * q[:, lone]
            q = self._next(q, np.ascontiguousarray(history[:, s].T).take(doc, axis=1), w, sums.totals[s])
        p[:, again] = q
        return p

    def run(self, batches: Iterator[pa.RecordBatch], sums: Sums) -> Iterator[pa.RecordBatch]:
        """The documents after one more round, and its sums."""
        for batch in batches:
            yield from self._batch(batch, sums)
        yield from self.ranges()

    def _batch(self, batch: pa.RecordBatch, sums: Sums) -> Iterator[pa.RecordBatch]:
        column = dict(zip(batch.schema.names, batch.columns))
        ids, many = _flat(column["ids"], np.int32)
        tf, own = _flat(column["tf"], np.int32)[0], _flat(column["own"], np.uint16)[0]
        hashes, lone_many = _flat(column["lone"], np.int64)
        stored, stored_many = _flat(column["p"], np.float64)
        history, _ = _flat(column["d"], np.float64)
        history = history.reshape(len(many), -1, self.k)
        starts, lone_at, stored_at = _starts(many), _starts(lone_many), _starts(stored_many)
        done, a = [], 0
        while a < len(many):
            b = max(int(np.searchsorted(starts, starts[a] + CHUNK, "right")) - 1, a + 1)
            own_part = slice(starts[a], starts[b])
            done.append(self._chunk(
                ids[own_part], tf[own_part], own[own_part], many[a:b], stored[stored_at[a] : stored_at[b]].reshape(-1, self.k),
                history[a:b], hashes[lone_at[a] : lone_at[b]], sums,
            ))
            a = b
        if not done:
            return
        if self.last:
            lone = np.concatenate([w for _, _, w in done])
            yield _rows(ids=_binary(hashes, np.array([0, len(hashes)])), part=[LONE], w=_binary(lone.ravel(), np.array([0, lone.size])))
            return
        p = np.concatenate([x for x, _, _ in done])
        kept = ((ids >= self.frequent) & (ids < self.shared)).astype(np.int64)
        ends = _starts(np.add.reduceat(kept, starts[:-1])) * self.k
        d = np.concatenate([history, np.concatenate([x for _, x, _ in done])[:, None]], axis=1)
        columns = {c: column[c] for c in ("ids", "tf", "own", "lone")}
        yield _rows(**columns, p=_binary(p.ravel(), ends), d=_binary(d.ravel(), np.arange(len(many) + 1) * d[0].size))

    def _chunk(self, ids, tf, own, many, stored, history, hashes, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some documents the shares to be stored, their sums, and the sums of terms of one document."""
        doc = np.repeat(np.arange(len(many)), many)
        tf = tf.astype(np.float64)
        p = self._so_far(ids, tf, own, doc, stored, history, sums)
        d = np.add.reduceat(tf * p, _starts(many)[:-1], axis=1)
        if sums.terms is not None:
            w = sums.terms.take(ids, axis=1)
            lone = np.flatnonzero(ids >= self.shared)
            w[:, lone] = tf[lone] * p[:, lone]
            p = self._next(p, d.take(doc, axis=1), w, sums.totals[-1])
        weighted = tf * p
        self._add(ids, weighted)
        kept = (ids >= self.frequent) & (ids < self.shared)
        return p[:, kept].T, d.T, weighted[:, ids >= self.shared].T

    def ranges(self) -> Iterator[pa.RecordBatch]:
        """The sums of a task, by ranges of terms."""
        met = np.flatnonzero(self.acc.sum(axis=0) > 0).astype(np.int32)
        bounds = np.searchsorted(met, np.arange(0, self.shared + RANGE, RANGE))
        for part, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            if hi > lo:
                w = self.acc[:, met[lo:hi]].T
                yield _rows(ids=[met[lo:hi].tobytes()], part=[part], w=[np.ascontiguousarray(w).tobytes()])
        yield _rows(part=[TOTALS], w=[self.all.tobytes()])

    def coded(self, batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
        """Documents out of (doc, name, terms) in the order of ``doc``, and the sums of their first shares.

        Rows of one ``doc`` are one document, also across batches. A pair's first topic is that of the md5 of ``name`` and term.
        """
        held: tuple | None = None
        for batch in batches:
            for some in _cuts(batch):
                docs, doc, pairs = self._pairs(some, terms)
                if held:
                    same = docs[0] == held[0]
                    docs = docs if same else [held[0], *docs]
                    doc = np.concatenate([np.zeros(len(held[1][0]), np.int64), doc + (not same)])
                    pairs = [np.concatenate(x) for x in zip(held[1], pairs)]
                cut = int(np.searchsorted(doc, len(docs) - 1))
                held = docs[-1], [x[cut:] for x in pairs]
                yield from self._first_rows(doc[:cut], [x[:cut] for x in pairs])
        if held:
            yield from self._first_rows(np.zeros(len(held[1][0]), np.int64), held[1])
        yield from self.ranges()

    def _pairs(self, batch: pa.RecordBatch, terms: Terms) -> tuple[list, np.ndarray, list[np.ndarray]]:
        """The different documents, and of every pair the document and (number, count, first topic, hash)."""
        every, names, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        new = [i for i in range(len(every)) if not i or every[i] != every[i - 1]]
        group = np.zeros(len(every), np.int64)
        group[new[1:]] = 1
        group = np.cumsum(group)
        row = np.repeat(np.arange(len(every)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        term, tf = flat.field("term"), flat.field("n").to_numpy(zero_copy_only=False)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        row, tf, coded = row[known], tf[known], term.filter(pa.array(known)).dictionary_encode()
        words = [w.encode() for w in coded.dictionary.to_pylist()]
        code, h = terms.codes(words)
        at = coded.indices.to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(code[at] >= 0) if len(at) else np.zeros(0, np.int64)
        row, tf, at = row[kept], tf[kept], at[kept]
        heads = [n.encode() for n in names]
        drawn = b"".join([md5(heads[r] + words[a]).digest()[:4] for r, a in zip(row.tolist(), at.tolist())])
        own = (np.frombuffer(drawn, ">u4") % self.k).astype(np.uint16)
        doc, number = group[row], code[at] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((number, doc))
        own_hash = h[at] if len(at) else np.zeros(0, np.int64)
        return [every[i] for i in new], doc[order], [number[order].astype(np.int32), tf[order].astype(np.int32), own[order], own_hash[order]]

    def _first_rows(self, doc: np.ndarray, pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, tf, own, h = pairs
        if not len(ids):
            return
        weighted = tf * self._first(own)
        self._add(ids, weighted)
        ends = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
        lone = ids >= self.shared
        lone_ends = _starts(lone)[ends]
        if self.last:
            yield _rows(ids=[h[lone].tobytes()], part=[LONE], w=[np.ascontiguousarray(weighted[:, lone].T).tobytes()])
            return
        yield _rows(ids=_binary(ids, ends), tf=_binary(tf, ends), own=_binary(own, ends), lone=_binary(h[lone], lone_ends))


def _cuts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows together up to ``CUT`` pairs, or a single longer one."""
    many = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
    starts, a = _starts(many), 0
    while a < len(many):
        b = max(int(np.searchsorted(starts, starts[a] + CUT, "right")) - 1, a + 1)
        yield batch.slice(a, b - a)
        a = b


def _rows(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in FIELDS], schema=FIELDS
    )


def added(table: pa.Table, k: int) -> tuple[int, np.ndarray]:
    """The part, and its sums over all tasks: (``RANGE``, k), or k of them over all terms."""
    part = table.column("part")[0].as_py()
    w = np.frombuffer(b"".join(table.column("w").to_pylist()), np.float64).reshape(-1, k)
    if part == TOTALS:
        return part, w.sum(axis=0)
    at = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int32) - part * RANGE
    return part, np.stack([np.bincount(at, w[:, j], RANGE) for j in range(k)], axis=1)
