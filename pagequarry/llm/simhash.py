"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Each text gets a 64-bit fingerprint. Equal fingerprints are one node. The bits are
cut into blocks: fingerprints at four or fewer differing bits agree on all blocks
but four at least. Each choice of that many blocks is a band, so linked fingerprints
meet in some band, and none is lost. Six blocks give 15 bands of two blocks; more
fingerprints take seven or eight, whose bands are more but hold longer agreements,
so that a cell stays small. The links are the same for any number. In a band a cell of equal bits is indexed as a tree: its fingerprints in
the order of their Gray rank, eight neighbours to a node, bits on which all of a
node agree factored out as its masked pattern, and a child holding only what its
parent lacks. All queries of a cell go down together, level by level; what they
differ by in each pattern adds up, and whole nodes are dropped once it exceeds
the limit. A cell's links leave it as a forest, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, connected_components, id_type, keyed, map_batches, materialize

WIDTH = 4  # words in a shingle
SEED = 42
DISTANCE = 4
BLOCKS = (6, 7, 8)  # numbers of blocks to choose from
MEAN_CELL = 256  # fingerprints in a cell of random bits, at most, unless even the last number gives more
FANOUT = 8
CELL = 4096  # fingerprints in a part of a cell; larger cells are compared part by part
FRONTIER = 1_000_000  # query and node pairs held at once
HASHES = 400_000  # hashes counted at once

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes, width: int = WIDTH, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a text's lower-cased bytes, repeats included."""
    words = raw.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(line[s:e], seed) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set, for the runs of hashes that begin at starts."""
    lengths = np.diff(np.append(starts, len(hashes)))
    parts = -(-lengths // 255)  # a byte lane counts to 255
    first = np.cumsum(parts) - parts
    at = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    out = np.empty((len(starts), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        out[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def fingerprints_of(raws: list[bytes], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Fingerprints as uint64; a text without words has zero."""
    out = np.zeros(len(raws), np.uint64)
    held: list[int] = []
    starts: list[int] = []
    rows: list[int] = []

    def flush() -> None:
        if rows:
            h, s = np.array(held, np.uint64), np.array(starts)
            n = np.diff(np.append(s, len(h)))
            bits = 2 * bit_counts(h, s) > n[:, None]
            out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
            held.clear(), starts.clear(), rows.clear()

    for i, raw in enumerate(raws):
        if h := shingle_hashes(raw, width, seed):
            starts.append(len(held))
            rows.append(i)
            held += h
            if len(held) >= HASHES:
                flush()
    flush()
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null is the empty text."""
    return map_batches(keyed(docs, id_col, text_col), lambda b: {"doc_id": b.column(0), "fp": fingerprints_of(bytes_of(b.column(1))).view(np.int64)}, f"doc_id {id_type(docs, id_col)}, fp long")


def masks(blocks: int) -> list[int]:
    """The bits of each band, as signed longs: every choice of all blocks but DISTANCE."""
    at, own = 0, []
    for k in range(blocks):
        width = 64 // blocks + (k < 64 % blocks)
        own.append(((1 << width) - 1) << at)
        at += width
    return [m - (1 << 64 if m >> 63 else 0) for m in map(sum, combinations(own, blocks - DISTANCE))]


def blocks_for(n: int) -> int:
    """The least number of blocks whose cells are small for n fingerprints."""
    return next((b for b in BLOCKS if n <= MEAN_CELL << (64 // b) * (b - DISTANCE)), BLOCKS[-1])


def _gray_rank(fp: Column) -> Column:
    """Where fp stands in the Gray code."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _runs(n_by_parent: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """First member of each run of up to fanout members that stay in one cell; runs by cell."""
    n_runs = -(-n_by_parent // fanout)
    first = np.cumsum(n_by_parent) - n_by_parent
    inner = np.arange(n_runs.sum()) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    return np.repeat(first, n_runs) + fanout * inner, n_runs


def links(fps: np.ndarray, cells: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j at distance or less, in parts. fps: in cells (lengths in cells), each in Gray order."""
    full = ~np.uint64(0)
    levels = [(fps, np.full(len(fps), full), np.arange(len(fps)), np.arange(len(fps)))]  # pattern, mask, first child, last fingerprint
    counts = cells
    while (counts > 1).any():
        pattern, mask, _, last = levels[-1]
        first, counts = _runs(counts, FANOUT)
        ends = np.append(first[1:], len(pattern)) - 1
        spread = np.repeat(first, np.diff(np.append(first, len(pattern))))
        shared = np.bitwise_and.reduceat(mask & ~(pattern ^ pattern[spread]), first)
        levels.append((pattern[first] & shared, shared, first, last[ends]))
    size = np.repeat(cells, cells)
    root = np.repeat(np.arange(len(cells)), cells)
    before = np.cumsum(size) - size
    begin = 0
    while begin < len(fps):
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + FRONTIER)))
        query, node = np.arange(begin, end), root[begin:end]
        pattern, mask, _, _ = levels[-1]
        differ = np.bitwise_count((fps[query] ^ pattern[node]) & mask[node]).astype(np.int16)
        for depth in range(len(levels) - 1, 0, -1):
            pattern, mask, first, last = levels[depth - 1]
            above_mask, above_first = levels[depth][1], levels[depth][2]
            keep = (differ <= distance) & (levels[depth][3][node] > query)
            query, node, differ = query[keep], node[keep], differ[keep]
            n = np.append(above_first[1:], len(pattern))[node] - above_first[node]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            child, above = np.repeat(above_first[node], n) + inner, np.repeat(node, n)
            query = np.repeat(query, n)
            differ = np.repeat(differ, n) + np.bitwise_count((fps[query] ^ pattern[child]) & mask[child] & ~above_mask[above])
            node = child
        keep = (differ <= distance) & (node > query)
        yield query[keep], node[keep]
        begin = end


def forest(fps: np.ndarray, cells: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the first one that it is linked to by a chain within its cell."""
    label = np.arange(len(fps))
    for i, j in links(fps, cells, distance):
        while len(i):
            a, b = label[i], label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low = np.minimum(a, b)
            np.minimum.at(label, np.maximum(a, b), low)
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the sorted cells of a partition: columns band, pattern, a, b, fp."""
    left: list[np.ndarray] | None = None

    def done(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
        fp = cols[4]
        label = forest(fp.view(np.uint64), np.diff(np.append(cuts, len(fp))))
        far = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], ["u", "v"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols)]
        n = len(cols[0])
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        at = cuts[-1]
        if at:
            yield done([c[:at] for c in cols], cuts[:-1])
        left = [c[at:].copy() for c in cols]
    if left is not None and len(left[0]):
        yield done(left, np.array([0]))


def link_fingerprints(fps: DataFrame, blocks: int) -> DataFrame:
    """A forest over the links between the distinct fingerprints of fps: u, v."""
    bands = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for k, m in enumerate(masks(blocks))])).alias("x")).select("x.band", "x.pattern", "fp")
    shared = materialize(bands.groupBy("band", "pattern").agg(F.count("*").alias("n")).where("n > 1"))
    met = bands.join(shared, ["band", "pattern"]).withColumn("q", F.ceil(F.col("n") / CELL).cast("int"))
    met = met.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("q")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    cells = met.select("band", "pattern", F.least("c", "j").alias("a"), F.greatest("c", "j").alias("b"), "fp")
    cells = cells.repartition("band", "pattern", "a", "b").sortWithinPartitions("band", "pattern", "a", "b", _gray_rank(F.col("fp")))
    return cells.mapInArrow(_search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id (the smallest doc_id that links reach) of every row.

    Null and empty texts share fingerprint zero and link like any other. Repeated
    rows each get their row. Rows with a null id are returned with the component of
    their text, whose id is null if no row in it has one. An empty table gives none. Ids
    may be of any type that has an order, as a struct that stands for a whole row. Very
    long texts are hashed in full, one after the other.
    """
    marked = materialize(fingerprint(docs, id_col, text_col))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(link_fingerprints(nodes.select("fp"), blocks_for(nodes.count())))
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id")).hint("rebalance")  # so that a huge component's rows can be split
    return marked.join(placed.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
