"""Secrets: fixed patterns, and strings that are new to a primed compressor.

A candidate is every unbroken string of 8 characters or more (as short as a value of the
assign pattern) shortly after a sensitive word, whatever it is made of. zstandard is
primed with a dictionary of identifiers: a fixed list, and those that occur most often
in the whole corpus, found by one aggregation. It compresses the surrounding code
without and with the candidate; the bytes it adds are its novelty. Words, identifiers
and repeats of what stands nearby add little; a random key adds nearly its own length,
and is reported. What reads as a name is not, unless a word of it is very long. A long candidate is measured in parts of like size, each after the one
before it, as a compressor finds a cheaper code for a long string of few characters,
however random, and against what a random string of its characters would hold at least.
README gives the measured shares that are found.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, bounded, id_type, keyed, map_batches, texts_of

KINDS = ("assign", "access", "hex")
NOVEL = "novel"
AROUND = 256  # code points of context on either side
SENSITIVE_WITHIN = 40  # code points before a candidate
# Least added bytes for each byte: with digits a share of what a random string of the same signs holds, as no code
# can take less for those. What reads as a name (words of one case each, parted by signs or capitals, with digits at
# its end at most) adds as much as random letters do when it is short: with no word of SOME_LETTERS it is not reported,
# with none of ALL_LETTERS it has to add LETTERS, and beyond that its share as all other strings.
SHARE = 0.92
SOME_LETTERS, ALL_LETTERS, LETTERS = 16, 32, 0.95
LEVEL, MATCH = 3, 5  # a match of fewer bytes would be chance
WHOLE, PART = 64, 48  # characters of a candidate that is measured whole, and of the parts of longer ones
LEARNT = 1500  # identifiers of the corpus in the dictionary: the most frequent ones
COUNTED = 200_000  # identifiers that a worker counts before it passes them on
# The identifiers that prime the compressor.
IDENTIFIERS = (
    "import return function class public static private const string number boolean true false null undefined "
    "configuration connection database username hostname localhost default environment variable application json "
    "request response header content-type authorization bearer client server session cookie context account "
    "http https www example com org net index value values result results options settings parameters arguments "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 abcdef0123456789 password secret token "
    "api_key access_key secret_key private_key public_key client_secret client_id your_api_key_here changeme placeholder "
    "version timestamp identifier description created_at updated_at 2020 2021 2022 2023 2024 2025 00000000 ffffffff xxxxxxxx "
)

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, as a run's first place matches all of it
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE = re.compile(r"pass|pwd|secret|token|api|key|auth|bearer|cred|private|signature|session", re.I | re.A)
_SIGNS = [(re.compile(own), size) for own, size in (("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26), ("[+/_-]", 2))]
_NAME = re.compile(r"[+/_-]*[a-z]?(?:(?:[A-Z]?[a-z]{2,}|[A-Z]+)(?:[+/_-]+|(?=[A-Z][a-z])|(?=[0-9]{0,4}=*\Z)))+[0-9]{0,4}=*")
_LETTERS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_IDENTIFIER = re.compile(r"[A-Za-z_]{4,24}(?![A-Za-z_])")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_À-ɏ-])[A-Za-z0-9+/_-]{8,}+(?![À-ɏ])={0,2}")  # no piece of a word with accents; as short as a value that ASSIGN has


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that hold, by start, then kind."""
    out = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple:
    return span[1], (*KINDS, NOVEL).index(span[0]), span[2]


def identifiers(docs: DataFrame, text_col: str = "text") -> tuple[str, ...]:
    """The LEARNT most frequent identifiers of letters in all texts, counted in the workers before they are
    shuffled; ties by name. Strings with digits, or of more than 24 letters, are never learnt. Null texts
    hold none, repeated rows count each, and an empty table teaches none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        batch_of = lambda: pa.RecordBatch.from_pydict({"w": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
        for batch in batches:
            for text in texts_of(batch.column(0)):
                seen.update(_IDENTIFIER.findall(text))
            if len(seen) >= COUNTED:
                yield batch_of()
                seen.clear()
        yield batch_of()

    rows = bounded(docs.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return tuple(r.w for r in rows.orderBy(F.desc("n"), "w").limit(LEARNT).collect())


@functools.lru_cache(4)
def _compressor(learnt: tuple[str, ...] = ()) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict((" ".join(reversed(learnt)) + " " + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, write_checksum=False, write_content_size=False)
    return zstandard.ZstdCompressor(dict_data=primed, compression_params=params)


def novelty(before: str, candidate: str, after: str, learnt: tuple[str, ...] = ()) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its own; of a long one the mean of its parts."""
    c = _compressor(learnt)
    n = 1 if len(candidate) <= WHOLE else -(-len(candidate) // PART)
    cuts = [len(candidate) * k // n for k in range(n + 1)]
    added, last = 0, ""
    for a, b in zip(cuts, cuts[1:]):
        around = (before + after + last).encode()
        last = candidate[a:b]
        added += len(c.compress(around + last.encode())) - len(c.compress(around))
    return added / len(candidate.encode())


def least_novelty(candidate: str) -> float:
    named = _NAME.fullmatch(candidate)
    if not re.search("[A-Za-z0-9]", candidate):
        return math.inf
    if named and (size := max(map(len, _LETTERS.findall(candidate)))) < ALL_LETTERS:
        return LETTERS if size >= SOME_LETTERS else math.inf
    signs = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", candidate) else sum(n for own, n in _SIGNS if own.search(candidate))
    return SHARE * math.log2(signs) / 8


def novel_spans(text: str, learnt: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    out = []
    if not _SENSITIVE.search(text):
        return out
    for m in _CANDIDATE.finditer(text):
        found, start, end = m[0], m.start(), m.end()
        if not _SENSITIVE.search(text, max(0, start - SENSITIVE_WITHIN), start):
            continue
        if (least := least_novelty(found)) < math.inf and novelty(text[max(0, start - AROUND) : start], found, text[end : end + AROUND], learnt) >= least:
            out.append((NOVEL, start, end))
    return out


def all_spans(text: str, learnt: tuple[str, ...] = ()) -> tuple[list, list]:
    """The base spans, and these with the novel ones that touch none of them."""
    base = base_spans(text)
    free = apart([(s, e) for _, s, e in base])
    added = [x for x in novel_spans(text, learnt) if free(*x[1:])]
    return base, sorted(base + added, key=_order) if added else base


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) of every row.

    Null and empty texts have no spans; repeated rows and null ids stay as they are, each
    with its result; very long texts are read in full; an empty table gives no rows. The
    corpus is read twice: for the identifiers of the dictionary, and for the strings.
    """
    learnt = identifiers(docs, text_col)

    def run(batch):
        both = [all_spans(t, learnt) for t in texts_of(batch.column(1))]
        dicts = [[[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in part] for part in zip(*both)]
        return {"doc_id": batch.column(0), "base": dicts[0], "spans": dicts[1]}

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_batches(keyed(docs, id_col, text_col), run, f"doc_id {id_type(docs, id_col)}, base {span}, spans {span}")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text; odd rows are as in scan()."""
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return scan(docs).select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
