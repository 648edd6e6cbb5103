"""Pairs of unit vectors above a threshold, block by block: all products are worked out, but none is stored that isn't a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Vectors of one block, and products of one step.
STRIPE, CELLS = 32_000, 4_000_000
#: Terms in at least this share of a block are multiplied as a dense matrix, the most frequent ones up to a width; all others by postings.
DENSE, WIDTH = 0.1, 1024
#: Products in single precision are off by less; those above the threshold less this are worked out again in double precision.
MARGIN = 1e-4

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Block:
    """The vectors of a block, ``offsets, term, x`` a row each, and what is alike to them."""

    def __init__(self, rows: Rows, threshold: float) -> None:
        self.offsets, term, self.x = rows
        self.threshold, self.n = threshold, len(self.offsets) - 1
        self.names, self.term = np.unique(term, return_inverse=True)
        of = np.repeat(np.arange(self.n), np.diff(self.offsets))
        df = np.bincount(self.term, minlength=len(self.names))
        often = np.flatnonzero(df >= DENSE * self.n)
        often = often[np.argsort(-df[often], kind="stable")[:WIDTH]]
        self.column = np.full(len(self.names), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = self._dense(of, self.term, self.x, self.n)
        rare = np.flatnonzero(self.column[self.term] < 0)
        rare = rare[np.lexsort((of[rare], self.term[rare]))]
        self.row, self.weight = of[rare], self.x[rare].astype(np.float32)
        # Postings by term and row, so that those from a row on are found.
        self.place = self.term[rare] * np.int64(self.n + 1) + self.row

    def _dense(self, of: np.ndarray, term: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, int(self.column.max(initial=-1)) + 1), np.float32)
        kept = self.column[term] >= 0
        out[of[kept], self.column[term[kept]]] = x[kept]
        return out

    def known(self, rows: Rows) -> Rows:
        """Rows of another block in this block's terms; others meet nothing."""
        offsets, term, x = rows
        at = np.minimum(np.searchsorted(self.names, term), max(0, len(self.names) - 1))
        kept = self.names[at] == term if len(self.names) else np.zeros(len(term), bool)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[kept]
        return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(offsets) - 1))]), at[kept], x[kept]

    def own(self) -> Iterator[Rows]:
        """``row, other, cosine`` of pairs within the block, each once."""
        rows = (self.offsets, self.term, self.x)
        step = max(1, CELLS // max(1, self.n))
        for i in range(0, self.n, step):
            r, c, cosine = self._alike(rows, i, min(self.n, i + step), i)
            yield r[c > r], c[c > r], cosine[c > r]

    def others(self, rows: Rows) -> Iterator[Rows]:
        """``row, own, cosine`` of pairs with the rows of another block."""
        rows = self.known(rows)
        n, step = len(rows[0]) - 1, max(1, CELLS // max(1, self.n))
        for i in range(0, n, step):
            yield self._alike(rows, i, min(n, i + step), 0)

    def _alike(self, rows: Rows, begin: int, end: int, first: int) -> Rows:
        """Rows ``begin`` to ``end`` against the block's from ``first`` on."""
        offsets, width = rows[0][begin : end + 1], self.n - first
        term, x = rows[1][offsets[0] : offsets[-1]], rows[2][offsets[0] : offsets[-1]]
        of = np.repeat(np.arange(end - begin), np.diff(offsets))
        products = self._dense(of, term, x, end - begin) @ self.matrix[first:].T
        flat = products.reshape(-1)
        rare = np.flatnonzero(self.column[term] < 0)
        starts = np.searchsorted(self.place, term[rare] * np.int64(self.n + 1) + first)
        counts = np.searchsorted(self.place, term[rare] * np.int64(self.n + 1) + self.n) - starts
        rare, starts, counts = rare[counts > 0], starts[counts > 0], counts[counts > 0]
        piece = np.cumsum(counts) // CELLS
        for k in range(int(piece[-1]) + 1 if len(piece) else 0):
            p = slice(*np.searchsorted(piece, [k, k + 1]))
            at, each = _ranges(starts[p], counts[p]), np.repeat(rare[p], counts[p])
            np.add.at(flat, of[each] * width + (self.row[at] - first), x[each].astype(np.float32) * self.weight[at])
        hit = np.flatnonzero(flat > self.threshold - MARGIN)
        left, right = hit // max(1, width), hit % max(1, width) + first
        cosine, seen = np.zeros(len(hit)), np.zeros(len(self.names))
        bounds = np.searchsorted(left, np.arange(end - begin + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            own, others = slice(offsets[i] - offsets[0], offsets[i + 1] - offsets[0]), right[bounds[i] : bounds[i + 1]]
            seen[term[own]] = x[own]
            size = np.diff(self.offsets)[others]
            at = _ranges(self.offsets[others], size)
            cosine[bounds[i] : bounds[i + 1]] = np.bincount(np.repeat(np.arange(len(others)), size), seen[self.term[at]] * self.x[at], len(others))
            seen[term[own]] = 0.0
        above = cosine > self.threshold
        return left[above] + begin, right[above], cosine[above]


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a list of terms as numbers with repeats, as the lists ``t, n`` of the terms in order, each once, and their counts."""
    for b in batches:
        lists = b.columns[-1]
        size = np.diff(lists.offsets.to_numpy())
        of, term = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
        order = np.lexsort((term, of))
        of, term = of[order], term[order]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (term[1:] != term[:-1])])[: len(of)])
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(size)))]), pa.int32())
        counts = np.diff(np.append(new, len(of)))
        columns = [*b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(term[new])), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "t", "n"])


def block_pairs(batches: Iterator[pa.RecordBatch], n_docs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """``slice, a, b, cosine`` of one block's documents: rows ``kind, slice, doc_id, t, n`` by kind, first the terms with their document
    frequencies where that is over 1, then the block's documents, then those of other blocks that they meet."""
    terms: list[np.ndarray] = []
    freqs: list[np.ndarray] = []
    own: list[Rows] = []
    names: list[str] = []
    block, known, df = None, np.zeros(0, np.int64), np.zeros(0)

    def weighed(b: pa.RecordBatch) -> Rows:
        lists, counts = b.column("t"), b.column("n").flatten().to_numpy()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        term, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(b)), np.diff(offsets))
        at = np.minimum(np.searchsorted(known, term), max(0, len(known) - 1))
        d = np.where(known[at] == term, df[at], 1.0) if len(known) else np.ones(len(term))
        w = counts * (np.log((1.0 + n_docs) / (1.0 + d)) + 1.0)
        return offsets - offsets[0], term, w / np.sqrt(np.bincount(of, w * w, len(b)))[of]

    def found(pairs: Iterator[Rows], left: list[str], where: int) -> Iterator[pa.RecordBatch]:
        for r, c, cosine in pairs:
            x, y = [left[i] for i in r], [names[i] for i in c]
            if x:
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(x), pa.int64()), pa.array([min(p) for p in zip(x, y, strict=True)]), pa.array([max(p) for p in zip(x, y, strict=True)]), pa.array(cosine)], ["slice", "a", "b", "cosine"])

    def built() -> Block:
        ends = np.cumsum([0] + [len(r[1]) for r in own])
        offsets = np.concatenate([[0], *[r[0][1:] + e for r, e in zip(own, ends[:-1], strict=True)]])
        return Block((offsets, np.concatenate([r[1] for r in own]), np.concatenate([r[2] for r in own])), threshold)

    where = 0
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for kind in np.unique(kinds):
            begin, end = np.searchsorted(kinds, [kind, kind + 1])
            b = batch.slice(begin, end - begin)
            if kind == 0:
                terms.append(b.column("t").flatten().to_numpy())
                freqs.append(b.column("n").flatten().to_numpy())
                continue
            if terms:
                known, df = np.concatenate(terms), np.concatenate(freqs).astype(float)
                order = np.argsort(known)
                known, df = known[order], df[order]
                terms, freqs = [], []
            where = b.column("slice")[0].as_py()
            if kind == 1:
                own.append(weighed(b))
                names += b.column("doc_id").to_pylist()
                continue
            if block is None and own:
                block = built()
                yield from found(block.own(), names, where)
            if block is not None:
                yield from found(block.others(weighed(b)), b.column("doc_id").to_pylist(), where)
    if block is None and own:
        yield from found(built().own(), names, where)
