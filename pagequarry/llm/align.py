"""Which tokens of one tokenizer stand for which of another, in texts and over the corpus.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model, which
puts a space before each text; A gets that space from here. One Arrow step tokenises and aligns:
the byte offsets where tokens of both end cut the tokens into groups, so that a group's tokens are
slices and the cost is linear; links are all pairs inside a group. All of that is operations on
whole arrays: Spark's higher-order functions, which go value by value and box each, took several times
as long. Counts of links are Spark's aggregates, shuffles and joins.

Blocks: texts are taken in blocks of BLOCK_BYTES, and a block's different words are
tokenised and aligned once; a text is the sequence of its words. That changes nothing, as no
match of A's pattern runs over a space before a letter or sign and no piece of B holds a space
after anything but spaces, so both tokenizers end a token at each such space (the files are
checked for that when they are loaded; with others each text is one word). A is run by
tiktoken, which takes a sixth of the time, where its merges stand in the order of its ids,
else by its own library; a test holds them equal. Joined bytes are compared; a text with a
word whose bytes differ has no tokens.

Counts: the links are written once. Each distinct pair of a text counts one for its pair of
ids, combined before the shuffle. Counts return to the links by two joins: the most frequent
pairs, at most BROADCAST_ROWS, are broadcast, the rest is shuffled; so no frequent pair
is a hot key, and no table is broadcast that was not counted. The highest count of each A id
is a table bounded by A's vocabulary.

Odd rows: null and empty texts, and those whose bytes a tokenizer does not give back, have no
tokens: zeros and ''. Each row of docs is a document, so repeated rows count each; rows
may share an id. Ties of the highest count are all best. Very long texts are one block and are
encoded whole; arrays of their words and links must fit a task. Other columns of docs are not
read, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, bounded, id_type, keyed, materialize, texts_of

BLOCK_BYTES = 2_000_000  # of texts whose words are tokenised once
PART_CHARS = 50_000  # given to a tokenizer at once
SENT_LINKS = 100_000  # of texts that are sent back at once, about

# Fixed: the split pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ODD = re.compile(r" \s|^ | $")  # spaces that are not single, or at an end
_BETWEEN = re.compile(r"(?<=[^ ]) (?=\S)")


def _byte_of() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str, quick: bool = True):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of, vocab = _byte_of(), told["model"]["vocab"] | {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], "int64") for t in (self.bytes_a, self.bytes_b))

        split = told.get("pre_tokenizer") or {}
        plain = not told.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.by_words = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in told["model"]["merges"]]
        special = {t["content"] for t in told.get("added_tokens", [])}
        ranks = {self.bytes_a[i]: i for token, i in vocab.items() if token not in special}
        ordered = plain and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
        if quick and ordered:
            self.a = Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path_a)
            own.encode_special_tokens = True
            self.a = lambda text: own.encode(text, add_special_tokens=False).ids

    def words(self, text: str) -> list[str]:
        """Parts of text between single spaces, which with a space before them are encoded alike alone and together."""
        if not text:
            return []
        if not self.by_words:
            return [text]
        return _BETWEEN.split(text) if _ODD.search(text) else text.split(" ")

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and text; None if either tokenizer does not give back the bytes."""
        a, b, own = self.a(f" {text}"), self.b.encode(text), f" {text}".encode()
        if b"".join([self.bytes_a[i] for i in a]) == own and b"".join([self.bytes_b[i] for i in b]) == own:
            return a, b
        return None

    def dictionary(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of the words one after the other, the byte offset where each word ends, and each word's place, -1 for those without tokens."""
        alone: list[list[int]] = []
        parts: list[list[int]] = [[]]
        chars = 0
        for k, w in enumerate(words):
            if not self.by_words or not w or w[0].isspace() or w[-1] == " ":
                alone.append([k])
                continue
            if chars > PART_CHARS:
                parts.append([])
                chars = 0
            parts[-1].append(k)
            chars += len(w)
        parts += alone
        place, a, b, sizes = np.full(len(words), -1), [], [], []
        while parts:
            at = parts.pop()
            found = self.encode(" ".join([words[k] for k in at])) if at else None
            if found:
                place[at] = np.arange(len(sizes), len(sizes) + len(at))
                a.append(np.array(found[0], "int32"))
                b.append(np.array(found[1], "int32"))
                sizes += [len(words[k].encode()) + 1 for k in at]
            elif len(at) > 1:
                parts += [[k] for k in at]
        none = np.empty(0, "int32")
        return np.concatenate([none, *a]), np.concatenate([none, *b]), np.cumsum(np.array(sizes, "int64")), place


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _from_zero(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype("int64")


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, "int32"), values)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and where each range starts among them."""
    starts = _from_zero(sizes)
    return np.repeat(first - starts[:-1], sizes) + np.arange(starts[-1]), starts


def _links(a: np.ndarray, starts_a: np.ndarray, b: np.ndarray, starts_b: np.ndarray, ids_b: int) -> pa.ListArray:
    """For each group all pairs of its slices of ids: every token of A with the slice of B of its group."""
    n_a, n_b = np.diff(starts_a), np.diff(starts_b)
    of_b = np.repeat(n_b, n_a)
    at_b, _ = _ranges(np.repeat(starts_b[:-1], n_a), of_b)
    return _lists(_from_zero(n_a * n_b), pa.array(np.repeat(a.astype("int64") * ids_b, of_b) + b[at_b]))


def _block(pair: Pair, texts: list[str]) -> dict:
    """n_a, n_b, n_groups, groups and links of each text: the block's words are tokenised and aligned one after the other, and a text is put together from the groups of its words."""
    index: dict[str, int] = {}
    own = [[index.setdefault(w, len(index)) for w in pair.words(t)] for t in texts]
    a, b, word_ends, place = pair.dictionary(list(index))
    ends_a, ends_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
    common = np.intersect1d(ends_a, ends_b)  # where groups end; a word's end is one of them
    starts_a, starts_b, starts = (_from_zero(np.diff(np.searchsorted(e, x), prepend=-1)) for e, x in ((ends_a, common), (ends_b, common), (common, word_ends)))
    said = pc.binary_join_element_wise(*[pc.binary_join(_lists(x, pa.array(ids).cast("string")), ",") for x, ids in ((starts_a, a), (starts_b, b))], "|")

    at = [place[w] if w else place[:0] for w in own]
    at = [x[:0] if len(x) and x.min() < 0 else x for x in at]
    words, bounds = np.concatenate([place[:0], *at]), _from_zero(np.array([len(x) for x in at], "int64"))
    held, group_bounds = _ranges(starts[words], np.diff(starts)[words])
    n_a, n_b = (np.diff(_from_zero(np.diff(x[starts])[words])[bounds]) for x in (starts_a, starts_b))
    bounds, held = group_bounds[bounds], pa.array(held)
    links = _links(a, starts_a, b, starts_b, len(pair.bytes_b)).take(held)
    link_bounds = _from_zero(links.value_lengths().to_numpy())[bounds]
    groups = pc.binary_join(_lists(bounds, said.take(held)), ";")
    return {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(np.diff(bounds)), "groups": groups, "links": _lists(link_bounds, links.flatten())}


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (written out) and links (a * B's size + b for each pair) of each text."""
    fields = [T.StructField("doc_id", T.DataType.fromDDL(id_type(docs, id_col))), *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")]]
    schema = T.StructType([*fields, T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, pair = to_arrow_schema(schema), _pair(path_a, path_b)

        def made(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            out = _block(pair, texts) | {"doc_id": pa.array(ids, arrow.field("doc_id").type)}
            block = pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in arrow], schema=arrow)
            rows = max(1, SENT_LINKS * len(ids) // max(1, len(out["links"].values)))
            for k in range(0, len(ids), rows):
                yield block.slice(k, rows)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                if ids and size + len(text) > BLOCK_BYTES:
                    yield from made(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield from made(ids, texts)

    return bounded(keyed(docs, id_col, text_col)).mapInArrow(run, schema)


def link_counts(linked: DataFrame, ids_b: int) -> DataFrame:
    """link, n (rows that hold it) and whether no link of its A id has more (best)."""
    counts = materialize(linked.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count("*").alias("n")))
    a = F.floor(F.col("link") / ids_b).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # bounded by A's vocabulary
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("link", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def _frequent(counts: DataFrame) -> int:
    """The least power of two such that at most BROADCAST_ROWS links are as frequent."""
    by = dict(counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect())  # 63 rows at most
    total, least = 0, max(by, default=0) + 1
    for k in sorted(by, reverse=True):
        total += by[k]
        if total > BROADCAST_ROWS:
            break
        least = k
    return 2**least


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row; the method stands at the module's head."""
    size_b, c = len(_pair(path_a, path_b).bytes_b), F.col
    found = groups(docs, path_a, path_b, id_col, text_col)
    some = c("n_a") > 0
    sha = F.when(some, F.sha2("groups", 256)).otherwise(F.lit(""))
    found = found.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), sha.alias("groups_sha256"), "links", F.monotonically_increasing_id().alias("row"))
    linked = materialize(found)
    counts = materialize(link_counts(linked, size_b))
    least = _frequent(counts)
    frequent, rare = F.broadcast(counts.where(c("n") >= least)), counts.where(c("n") < least)
    total = lambda v, name: F.sum(F.coalesce(v, F.lit(0))).alias(name)
    sums = linked.select("row", F.explode("links").alias("link")).join(frequent, "link", "left").groupBy("row").agg(total("best", "n_best"), total("n", "count_sum"))
    if not rare.isEmpty():
        rest = linked.select("row", F.explode("links").alias("link")).join(frequent, "link", "left_anti").join(rare, "link")
        sums = sums.unionByName(rest.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")))
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = linked.drop("links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
