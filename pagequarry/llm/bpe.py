"""Byte-level BPE by monoid tree reduction.

A piece (one match of the split pattern) is halved down to short leaves; leaves
are merged directly, and neighbours are joined by encoding a window across their
border again. Why a window is enough: call neighbours x, y stable if merging the
bytes of xy alone gives x, y back. Suppose that every two neighbours of a token
sequence are stable, and that merging the whole text makes some merge over a
border; take the first, over the border of x and y. Until then all merges lie
within tokens, and those within x and y are the merges of xy alone, in the same
order, as the lowest rank of all is the lowest of these two when it lies in them
(ties go left in both). So xy alone would make that merge as well, against its
stability. Hence a sequence of stable neighbours is the encoding. Two encodings
are joined by growing the window until both its outer borders are stable: inside
the halves and the window neighbours are stable as they are encodings.

Pieces are separate by definition, so a text is the concatenation of its pieces,
and decoding concatenates halves up the tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keyed, map_batches, texts_of

LEAF = 3  # bytes merged directly
HEAPED = 96  # bytes from which on a direct merge keeps its pairs in a heap
SHARED = 16  # bytes of halves and windows whose encodings are kept, as words share theirs
CACHED = 200_000  # pieces, and as many halves and pairs, kept by a worker


class _Kept(dict):
    """What a function gives, filled on demand. When CACHED values are held they become the older ones, of which
    those that are asked for again are kept, so memory is bounded and frequent keys stay."""

    def __init__(self, of):
        super().__init__()
        self.of, self.older = of, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.of(key)
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder for a file of ranks and a split pattern; both are parameters."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.names = [str(i) for i in range(len(self.bytes))]
        # White space as the Unicode property, which leaves out the separators U+001C to U+001F.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        # Ids of pieces and of halves, and which neighbours are stable. Long pieces are not kept; nobody may change a value.
        self.pieces = _Kept(lambda piece: tuple(self.encode_piece(piece.encode())))
        self.halves, self.windows = _Kept(self.reduce), _Kept(self.merge)
        self.stable = _Kept(lambda pair: self.merge(self.bytes[pair[0]] + self.bytes[pair[1]]) == [*pair])

    def merge(self, raw: bytes) -> list[int]:
        """Merges from single bytes, lowest rank first, the leftmost of equals."""
        ranks = self.ranks
        if len(raw) > HEAPED:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        near = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            least = min((r for r in near if r is not None), default=None)
            if least is None:
                return [ranks[p] for p in parts]
            i = near.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1])
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i])

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same by a heap of (rank, start) and linked parts."""
        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, middle, stop = heappop(heap)
            if end[i] != middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings. Neighbours are stable if they stay when only their bytes are merged."""
        stable = self.stable
        if stable[left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            raw = b"".join(map(self.bytes.__getitem__, left[len(left) - i :] + right[:j]))
            window = self.windows[raw] if len(raw) <= SHARED else self.merge(raw)
            left_holds = i == len(left) or stable[left[-i - 1], window[0]]
            right_holds = j == len(right) or stable[window[-1], right[j]]
            if left_holds and right_holds:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def reduce(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.merge(raw)
        half = len(raw) // 2
        if half < SHARED:
            return self.join(self.halves[raw[:half]], self.halves[raw[half:]])
        return self.join(self.reduce(raw[:half]), self.reduce(raw[half:]))

    def encode_piece(self, raw: bytes) -> list[int]:
        """A piece that is a token itself is that token, merged or not."""
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.reduce(raw)

    def encode(self, text: str) -> list[int]:
        found = self.split.findall(text)
        if len(text) > HEAPED and len(max(found, key=len, default="")) > HEAPED:
            return list(chain.from_iterable(self.pieces[p] if len(p) <= HEAPED else self.encode_piece(p.encode()) for p in found))
        return list(chain.from_iterable(map(self.pieces.__getitem__, found)))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker and vocabulary."""
    return Codec(path, pattern)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have no ids.

    Repeated rows and null ids are rows like any other; very long texts are encoded in full,
    in one worker's memory; an empty table gives no rows. Other columns are not read.
    """

    def run(batch):
        c = codec(path, pattern)
        ids = [np.array(c.encode(t), np.int32) for t in texts_of(batch.column(1))]
        return {"doc_id": batch.column(0), "ids": _lists(ids)}

    return map_batches(keyed(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (the bytes) of rows with ids; null ids are none.

    Repeated rows are rows like any other, long arrays are decoded by halves, an empty table
    gives no rows, and an id that is not of the vocabulary is an error. Other columns are not read.
    """

    def run(batch):
        c = codec(path, pattern)
        return {"doc_id": batch.column(0), "decoded": [c.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes the ids: doc_id, n_tokens, and SHA-256 of the ids as decimals
    joined by commas and of the decoded bytes; with_ids adds the ids. Texts that are null or empty
    have no tokens; repeated rows and null ids are rows like any other; very long texts are encoded in full,
    in one worker's memory; an empty table gives no rows."""

    def run(batch):
        c = codec(path, pattern)
        n, sha_ids, sha_text, kept = [], [], [], []
        for text in texts_of(batch.column(1)):
            ids = c.encode(text)
            n.append(len(ids))
            sha_ids.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
            sha_text.append(hashlib.sha256(c.decode(ids)).hexdigest())
            if with_ids:
                kept.append(np.array(ids, np.int32))
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": sha_ids, "decoded_sha256": sha_text} | ({"ids": _lists(kept)} if with_ids else {})

    return map_batches(keyed(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
