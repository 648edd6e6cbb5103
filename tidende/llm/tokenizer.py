"""Encoding with a public byte-level BPE vocabulary by forced-boundary splitting."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Where the vocabularies of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
#: The published pre-tokenisation pattern of this vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept encoded in a worker; the store is emptied beyond it.
CACHE = 500_000


class ByteBPE:
    """Ids of texts: pieces by the pattern, cut at forced boundaries, each fragment encoded alone, joined again.

    A pair of bytes that stands side by side inside no token of the vocabulary can't be bridged by any merge, so between
    the two a cut is certain and the fragments don't influence each other.
    """

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        inside = np.zeros(65536, dtype=bool)
        for token in self.ranks:
            if len(token) > 1:
                b = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
                inside[b[:-1] * 256 + b[1:]] = True
        self.inside = inside
        self.find = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, data: bytes) -> list[bytes]:
        """``data`` cut wherever its neighbouring bytes are side by side in no token."""
        if len(data) < 2:
            return [data] if data else []
        b = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        at = np.flatnonzero(~self.inside[b[:-1] * 256 + b[1:]]) + 1
        bounds = [0, *at.tolist(), len(data)]
        return [data[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Byte pair merges of one fragment, lowest rank first, leftmost among equal ones; n log n by a heap."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        n = len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(pair := joined + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, pair))
            if (h := before[i]) >= 0 and (r := ranks.get(pair := parts[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, pair))
        return tuple(ranks[p] for p in parts if p is not None)

    def piece(self, piece: str) -> tuple[int, ...]:
        ids: list[int] = []
        for fragment in self.cuts(piece.encode("utf-8", "surrogatepass")):
            if (known := self.fragments.get(fragment)) is None:
                known = self.merge(fragment)
                if len(fragment) < 64:
                    if len(self.fragments) > CACHE:
                        self.fragments.clear()
                    self.fragments[fragment] = known
            ids += known
        if len(piece) < 64:
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            self.pieces[piece] = tuple(ids)
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known, extend, piece = self.pieces.get, ids.extend, self.piece
        for x in self.find(text or ""):
            extend(known(x) or piece(x))
        return ids


def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The rank file of a vocabulary, read on the driver and sent along, about a megabyte."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``ids array<int>`` of ``text``; a null or empty text has the empty list.

    One pass without shuffle; whole texts, however long. Strings of special tokens are ordinary text. An ``ids`` column of the
    input is replaced.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(load(name, folder))
    keep = [c for c in (keep or df.columns) if c != ids]
    read = list(dict.fromkeys([*keep, text]))
    schema = StructType([*(df.schema[c] for c in keep), StructField(ids, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(vocabulary.value)
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for t in batch.column(read.index(text)).to_pylist():
                flat += bpe.encode(t)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(read.index(c)) for c in keep), lists], [*keep, ids])

    return df.select(*read).mapInArrow(run, schema)
