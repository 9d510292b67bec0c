"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An item of n words is held by a text if a local alignment of both scores at least
``least(n)``: half of its words, but no fewer than three of them, or all where it has
fewer. An alignment that reaches this has so few errors that many of the item's word
pairs stay intact in it: with m matches and e errors its matches form at most e + 1
runs, so m - e - 1 pairs at least, its score less one; and it spans m + e words at most.
Three steps follow from that, and none of them can lose such an alignment:

1. Passages. One scan of the documents keeps the stretches that are dense enough in
   word pairs of items, by a table of bounded size that tells the lengths of the items
   that a pair may belong to. Equal passages are one from there on.
2. Seeds. Every pair of an item is counted over the passages, and so many of the rarest
   are its seeds that fewer pairs are left than an alignment keeps. Seeds join passages
   to items in one shuffle, with frequent seeds salted.
3. Alignment. Of each pair of passage and item the stretches that are dense in this
   item's pairs are aligned word by word.

Nothing of the items or the documents is collected but the table of step 1, whose
size is ``SLOTS`` at most however many items there are. The plan is the same for any
number of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, id_type, keyed, map_batches, materialize

GRAM = 2  # words in a seed; the count of intact ones holds for pairs only
MIN_SCORE = 0.5  # matches less mismatches and gaps, for each word of the item
MIN_MATCH = 3  # least score of an item that has as many words; shorter ones have to be there in full
SLOTS = 1 << 23  # of four bytes each, in the table of the items' pairs at most
SLOTS_EACH = 16  # for each pair, while that is below SLOTS
CLASSES = 32  # of item lengths
HOT_SHARE, HOT_LEAST, SALTS = 1000, 10_000, 64  # a pair that is more than one in HOT_SHARE of all is spread over SALTS tasks
SLICE = 1_000_000  # bytes hashed at once

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ALONE = np.uint64(0xD6E8FEB86659FD93)  # tells single words from pairs

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
# Ranges of code points that are written without spaces, where each character is a word.
UNSPACED = (
    (0x0E00, 0x0FFF),  # Thai, Lao, Tibetan
    (0x1000, 0x109F),  # Myanmar
    (0x1780, 0x17FF),  # Khmer
    (0x1950, 0x19FF),  # Tai Le, New Tai Lue, Khmer symbols
    (0x1A20, 0x1AAF),  # Tai Tham
    (0x3000, 0x9FFF),  # kana, Han and their signs
    (0xA000, 0xA4CF),  # Yi
    (0xA980, 0xA9DF),  # Javanese
    (0xAA00, 0xAA7F),  # Cham, Myanmar
    (0xF900, 0xFAFF),  # Han
    (0x10000, 0x10FFFF),  # Han and others of four bytes
)
# By the first two bytes of a character, which tell such ranges to 64 code points, whether each is a word.
_FIRST = np.zeros(256, bool)
_PAIR = np.zeros((256, 256), bool)
for _a, _b in UNSPACED:
    for _c in range(_a, _b + 1, 64):
        _raw = chr(_c).encode()
        _FIRST[_raw[0]] = _PAIR[_raw[0], _raw[1]] = True
_CJK_PUNCTUATION = (0xE3, 0x80)


def folded(raw: bytes) -> bytes:
    """Lower case by code point; both small forms of sigma are one."""
    return raw if raw.isascii() else raw.decode().lower().replace("ς", "σ").encode()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of P and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, x, np.uint64)))) for x in (_P, _P_INV))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _borders(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in a buffer."""
    word = _WORD[raw]
    at = np.flatnonzero(_FIRST[raw])
    at = at[_PAIR[raw[at], raw[np.minimum(at + 1, len(raw) - 1)]]]
    if not len(at):
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    signs = at[(raw[at] == _CJK_PUNCTUATION[0]) & (raw[np.minimum(at + 1, len(raw) - 1)] == _CJK_PUNCTUATION[1])]
    for k in range(3):
        word[np.minimum(signs + k, len(raw) - 1)] = False
    cut = np.zeros(len(raw) + 4, bool)
    cut[at] = cut[at + np.where(raw[at] < 0xF0, 3, 4)] = True
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    return np.flatnonzero(word & (~before | cut[: len(raw)])), np.flatnonzero(word & (~after | cut[1 : len(raw) + 1])) + 1


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer and where they start."""
    starts, ends = _borders(raw)
    up, down = _POWERS.to(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw] + np.uint64(1)) * up[: len(raw)])))
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def hashes(raws: list[bytes]) -> list[np.ndarray]:
    """The hash of each word of each text. Words are runs of ASCII letters, digits and all characters beyond
    ASCII, in lower case; of the ranges UNSPACED each character is a word by itself, but for CJK signs."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            h, at = _hash_words(np.frombuffer(b" ".join(held), np.uint8))
            ends = np.cumsum([len(x) + 1 for x in held])
            out.extend(np.split(h, np.searchsorted(at, ends[:-1])))
            held.clear()
            size = 0

    for raw in map(folded, raws):
        if len(raw) > SLICE:
            flush()
            parts, at = [], 0
            while at < len(raw):
                end = raw.find(b" ", at + SLICE)
                end = len(raw) if end < 0 else end
                parts.append(_hash_words(np.frombuffer(raw[at:end], np.uint8))[0])
                at = end
            out.append(np.concatenate(parts))
            continue
        held.append(raw)
        size += len(raw)
        if size >= SLICE:
            flush()
    flush()
    return out


def grams(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = _mix(h * _P + words[k : k + n])
    return h


def alone(words: np.ndarray) -> np.ndarray:
    """What stands for single words among the pairs, for items of one word."""
    return _mix(words ^ _ALONE)


def least(n: int) -> int:
    """The least score that an item of n words is reported with."""
    return max(-int(-MIN_SCORE * n // 1), min(n, MIN_MATCH))


def span(n: int) -> int:
    """Words of a text that an alignment with an item of n words reaches over at most."""
    return 2 * n - least(n)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment: its score (1 a match, -1 a mismatch or gap) and where it ends in the passage."""
    n = len(passage)
    ramp, row, best, end = np.arange(n + 1), np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, 1, -1), row[1:] - 1)
        row = np.maximum(np.maximum.accumulate(new + ramp) - ramp, 0)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def dense(at: np.ndarray, group: np.ndarray | None, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all stretches of ``width`` words with ``count`` of the pairs at ``at`` (sorted) of one group."""
    if len(at) < count:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = at[: len(at) - count + 1], at[count - 1 :]
    fits = last - first <= width - GRAM
    if group is not None:
        fits &= group[: len(at) - count + 1] == group[count - 1 :]
    return last[fits] + GRAM - width, first[fits] + width


def joined(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """The union of stretches, as far as they overlap."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, start[1:] >= end[:-1])) if len(start) else []
    return zip((int(start[a]) for a in new), (int(end[b - 1]) for b in np.append(new[1:], len(start)))) if len(start) else iter(())


def best_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int] | None:
    """Score, start and end of the best alignment of an item with a passage, if it reaches the least score."""
    n = len(item)
    if n == 1:
        at = np.flatnonzero(words == item[0])
        return (1, int(at[0]), int(at[0]) + 1) if len(at) else None
    hit = np.flatnonzero(np.isin(grams(words), grams(item)))
    best = None
    for a, b in joined(*dense(hit, None, least(n) - 1, span(n))):
        part = words[max(0, a) : b]
        score, end = align(item, part)
        if score >= least(n) and (best is None or score > best[0]):
            back = align(item[::-1], part[:end][::-1])[1]
            best = score, max(0, a) + end - back, max(0, a) + end
    return best


def class_of(n: np.ndarray) -> np.ndarray:
    """The class of lengths: each from 1 to 4, then steps of a quarter."""
    bounds, low = [], 1
    while len(bounds) < CLASSES - 1:
        low = max(low + 1, low * 5 // 4)
        bounds.append(low)
    return np.searchsorted(bounds, n, "right")


@dataclass
class Filter:
    """For the pairs of items by the first bits of their hash: the classes of items that have one (a bit each).

    needs: class, least number of pairs and greatest span of its items.
    """

    table: np.ndarray
    needs: list[tuple[int, int, int]]

    def classes(self, g: np.ndarray) -> np.ndarray:
        return self.table[slots(g, len(self.table))]

    def passages(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """Text, start and end of the stretches that can hold an item."""
        size = np.array([len(w) for w in texts], np.int64)
        flat = np.concatenate([*texts, np.empty(0, np.uint64)])
        ends = np.cumsum(size)
        found = []
        kinds = [x[0] for x in self.needs]
        if 0 in kinds:
            at = np.flatnonzero(self.classes(alone(flat)) & np.uint32(1))
            found.append((at, at + 1, np.searchsorted(ends, at, "right")))
        g = grams(flat)
        classes = self.classes(g)
        classes[(ends[size > 0] - 1)[ends[size > 0] <= len(g)]] = 0  # pairs that reach into the next text
        hit = np.flatnonzero(classes)
        classes, text = classes[hit], np.searchsorted(ends, hit, "right")
        for kind, count, width in self.needs:
            if kind:
                own = np.flatnonzero(classes & np.uint32(1 << kind))
                a, b = dense(hit[own], text[own], count, width)
                if len(a):
                    t = np.searchsorted(ends, b - width, "right")  # of the first pair
                    found.append((np.maximum(a, ends[t] - size[t]), np.minimum(b, ends[t]), t))
        if found:
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            for s, e in joined(a, b):
                t = int(np.searchsorted(ends, s, "right"))
                yield t, s - int(ends[t] - size[t]), e - int(ends[t] - size[t])


def slots(g: np.ndarray, size: int) -> np.ndarray:
    return (g >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Word hashes of each row of an array column."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return np.split(flat, (ends[1:-1] - ends[0])) if len(column) else []


def _words(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))


def _item_grams(words: np.ndarray) -> np.ndarray:
    return alone(words) if len(words) == 1 else grams(words)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct items (i, words) and the ids (i, item_id) of each; items without words are left out."""

    def run(batch):
        return {"item_id": batch.column(0), "words": _words(hashes(bytes_of(batch.column(1))))}

    texts = benchmark.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(map_batches(texts, run, "item_id long, words array<long>").where("size(words) > 0").withColumn("i", F.xxhash64("words")))
    return materialize(rows.select("i", "words").dropDuplicates(["i"])), rows.select("i", "item_id")


def _filter(items: DataFrame) -> Filter | None:
    """The table of the items' pairs, or None without items. At most SLOTS numbers reach the driver."""
    sizes = items.select(F.size("words").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0]
    if total is None:
        return None
    size = 1 << min(SLOTS.bit_length() - 1, max(12, (int(total) * SLOTS_EACH).bit_length()))

    def run(batch):
        slot, bit, low, high = [], [], {}, {}
        words = _arrays(batch.column(0))
        for w, c in zip(words, class_of(np.array([len(w) for w in words])).tolist()):
            s = np.unique(slots(_item_grams(w), size))
            slot.append(s)
            bit.append(np.full(len(s), 1 << c, np.int64))
            low[c], high[c] = min(low.get(c, len(w)), len(w)), max(high.get(c, 0), len(w))
        for c in low:  # rows below zero tell the lengths of a class
            slot.append(np.array([-1 - c]))
            bit.append(np.array([low[c] << 32 | high[c]]))
        return {"slot": np.concatenate(slot), "bits": np.concatenate(bit)}

    rows = map_batches(items.select("words"), run, "slot int, bits long")
    lengths = rows.where("slot < 0").select((-1 - F.col("slot")).alias("c"), F.shiftright("bits", 32).alias("a"), F.col("bits").bitwiseAND((1 << 32) - 1).alias("b"))
    found = lengths.groupBy("c").agg(F.min("a").alias("a"), F.max("b").alias("b")).collect()  # CLASSES rows at most
    got = rows.where("slot >= 0").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # SLOTS rows at most
    table = np.zeros(size, np.uint32)
    table[got.column("slot").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return Filter(table, [(r.c, least(r.a) - 1, span(r.b)) for r in sorted(found)])


def _salted(rows: DataFrame, hot: DataFrame, salt: Column) -> DataFrame:
    """hot: HOT_SHARE rows at most, as no more pairs can have so large a share of all."""
    marked = rows.join(F.broadcast(hot.select("gram", F.lit(True).alias("hot"))), "gram", "left")
    return marked.withColumn("salt", F.when(F.col("hot"), salt)).drop("hot")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, start_word and end_word of each test item that a row's text holds.

    score is the best alignment's for each word of the item, at most 1; of equal ones
    the passage that starts first is told. Null and empty texts hold nothing, and items
    that are null or have no word are held by none. Repeated rows, of documents or items,
    are each reported, and so are rows with a null id; very long texts are searched
    in full; empty tables give no rows. Ids may be of any type, those of items are numbers.
    """
    spark, own = docs.sparkSession, id_type(docs, id_col)
    out = f"doc_id {own}, item_id long, score double, start_word long, end_word long"
    items, ids = _items(benchmark, item_col, text_col)
    table = _filter(items)
    if table is None:
        return spark.createDataFrame([], out)
    sent = spark.sparkContext.broadcast(table)

    def keep(batch):
        words = hashes(bytes_of(batch.column(2)))
        found = list(sent.value.passages(words))
        at = pa.array([t for t, _, _ in found], pa.int64())
        return {"row": batch.column(0).take(at), "doc_id": batch.column(1).take(at), "start": [s for _, s, _ in found], "words": _words([words[t][s:e] for t, s, e in found])}

    texts = keyed(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    places = map_batches(texts, keep, f"row long, doc_id {own}, start long, words array<long>")
    places = materialize(places.select("*", F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b")).alias("p")))
    passages = materialize(places.select("p", "words").dropDuplicates(["p"]))

    def pairs(batch):
        at, out = [], []
        for k, w in enumerate(_arrays(batch.column(1))):
            g = np.unique(np.concatenate((grams(w), alone(w)))) if sent.value.needs[0][0] == 0 else np.unique(grams(w))
            g = g[sent.value.classes(g) > 0]
            at.append(np.full(len(g), k))
            out.append(g)
        return {"p": batch.column(0).take(pa.array(np.concatenate(at))), "gram": np.concatenate(out).view(np.int64)}

    of = f"p {passages.schema['p'].dataType.simpleString()}"
    hits = materialize(map_batches(passages.select("p", "words"), pairs, f"{of}, gram long"))

    def item_pairs(batch):
        words = _arrays(batch.column(1))
        g = [_item_grams(w) for w in words]
        n = [len(x) for x in g]
        return {"i": batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), "spare": np.repeat([max(0, least(len(w)) - 2) for w in words], n), "gram": np.concatenate(g).view(np.int64)}

    # An alignment holds more of the item's pairs than are spared here, and all of those are in passages.
    counts = materialize(hits.groupBy("gram").agg(F.count("*").alias("n")))
    item = Window.partitionBy("i")
    seeds = map_batches(items, item_pairs, "i long, spare int, gram long").join(counts, "gram")
    seeds = seeds.select("i", "gram", (F.count("*").over(item) - F.col("spare")).alias("seeds"), F.row_number().over(item.orderBy("n", "gram")).alias("rank"))
    seeds = materialize(seeds.where("rank <= seeds").select("i", "gram").distinct())
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(total // HOT_SHARE, HOT_LEAST))
    spread = _salted(hits, hot, F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int")).fillna(0, ["salt"])
    many = _salted(seeds, hot, F.lit(1)).withColumn("salt", F.explode(F.when(F.col("salt") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = spread.join(many, ["gram", "salt"]).select("p", "i").distinct()

    def score(batch):
        found = [best_match(i, w) for i, w in zip(_arrays(batch.column(2)), _arrays(batch.column(3)))]
        at = pa.array([k for k, f in enumerate(found) if f], pa.int64())
        size = pa.compute.list_value_length(batch.column(2)).to_numpy()[at.to_numpy()]
        s, a, b = np.array([f for f in found if f], np.int64).reshape(-1, 3).T
        return {"p": batch.column(0).take(at), "i": batch.column(1).take(at), "score": s / size, "first": a, "last": b}

    both = met.join(items, "i").withColumnRenamed("words", "own").join(passages, "p").select("p", "i", "own", "words")
    scored = map_batches(both, score, f"{of}, i long, score double, first long, last long")
    best = F.max(F.struct("score", (-F.col("start") - F.col("first")).alias("before"), (F.col("start") + F.col("last")).alias("end"))).alias("best")
    told = places.drop("words").join(scored, "p").groupBy("row", "i").agg(F.first("doc_id").alias("doc_id"), best).join(ids, "i")
    return told.select("doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.before")).alias("start_word"), F.col("best.end").alias("end_word"))
