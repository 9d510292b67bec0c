"""Language identification by Bayesian fusion of evidence.

The text gives a likelihood by smoothed byte trigrams, fitted on a bounded sample
of labelled rows; the declared markup language and the address suffix give theirs;
the host gives a prior. Priors are shares of languages summed over all rows of a
host, each level smoothed towards the one above: host, domain, suffix, all. A class
"und" stands for text of no known language: its trigrams are all alike likely.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, map_batches, materialize, small_side

SAMPLE = 1000  # labelled rows of a language to fit on at most: those of smallest hash of the id
BUCKETS = 1 << 14
MIXED = 0.1  # of each language's chances go evenly to all buckets
TEMPER = 0.25  # neighbouring trigrams overlap, so they count less than independent ones
STRENGTH = 5.0  # rows that the level above counts as
DECLARED = 0.9  # chance that markup declares the language of the text
SUFFIXED = 0.7  # chance that a suffix with a language has text in it
SLICE = 1_000_000
UNKNOWN = "und"
# Country suffixes with one main language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko"}

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER[~_LETTER] = 32  # digits and signs are of no language


def codes(raw: np.ndarray) -> np.ndarray:
    """The bucket of the byte trigram at each place but the last two."""
    b = _LOWER[raw]
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(18)).astype(np.int64)


def _parts(raws: list[bytes]):
    """Groups of texts of about SLICE bytes: first row, texts."""
    at, size = 0, 0
    for k, raw in enumerate(raws):
        size += len(raw)
        if size >= SLICE or k == len(raws) - 1:
            yield at, raws[at : k + 1]
            at, size = k + 1, 0


def counts(raws: list[bytes]) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for _, part in _parts(raws):
        buffer = np.frombuffer(b"  ".join([*part, b" "]), np.uint8)
        if len(buffer) > 2:
            out += np.bincount(codes(buffer), minlength=BUCKETS)
    return out


def likelihoods(raws: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log chances of each text's trigrams, (texts, classes), and the number of its letters."""
    out, letters = np.zeros((len(raws), len(table))), np.zeros(len(raws), np.int64)
    for at, part in _parts(raws):
        buffer = np.frombuffer(b"".join(b"  " + x + b"  " for x in part), np.uint8)
        starts = np.cumsum([0, *(len(x) + 4 for x in part[:-1])])
        code = codes(buffer)  # places that reach into the next text see white space only
        for k, row in enumerate(table):
            out[at : at + len(part), k] = np.add.reduceat(row[code], starts)
        letters[at : at + len(part)] = np.add.reduceat(_LETTER[buffer].astype(np.int64), starts)
    return out, letters


class Profile:
    """Languages and the table (languages and und, buckets) of log chances."""

    def __init__(self, languages: list[str], seen: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        even = 1 / BUCKETS
        share = (1 - MIXED) * (seen + even) / (seen.sum(1, keepdims=True) + 1) + MIXED * even
        self.table = np.log(np.concatenate([share, np.full((1, BUCKETS), even)]))
        self.table[:, codes(np.full(3, 32, np.uint8))] = 0  # gaps tell nothing


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Profile:
    """Fits every label, on at most SAMPLE ids of each: those of smallest hash, with all rows of each of them.

    Rows with a null id or without a label are not learnt from, null and empty texts tell
    nothing, very long ones are read in full; labels that differ in case are one. Ids of
    equal hash are one id. An empty table, or one without labels, gives a profile of no language.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.lower(F.col(label_col).cast("string")).alias("l")).where("i is not null and l <> ''")
    rows = rows.where(F.col("l") != UNKNOWN).withColumn("h", F.xxhash64("i"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("i").alias("n")).collect()}
    found = sorted(sizes)
    seen = np.zeros((len(found), BUCKETS), np.int64)
    if found:
        spark, schema = docs.sparkSession, "l string, most long"
        # Hashes below which about twice SAMPLE ids lie, then those that SAMPLE ids reach: two short values for each label.
        near = spark.createDataFrame([(x, min((1 << 63) - 1, (2 * SAMPLE << 64) // max(1, n) - (1 << 63))) for x, n in sizes.items()], schema)
        lowest = F.array_sort(F.collect_set("h"))
        ends = rows.join(F.broadcast(near), "l").where("h <= most").groupBy("l").agg(lowest.alias("hs"), F.first("most").alias("near"))
        ends = ends.select("l", F.coalesce(F.get("hs", F.lit(SAMPLE - 1)), "near").alias("most")).collect()
        texts = rows.join(F.broadcast(spark.createDataFrame([tuple(r) for r in ends], schema)), "l").where("h <= most").select("l", "t")

        def count(batch):
            names = batch.column(0).to_pylist()
            raws = bytes_of(batch.column(1))
            own = sorted(set(names))
            by = [counts([r for n, r in zip(names, raws) if n == x]) for x in own]
            l, b, n = [], [], []
            for x, c in zip(own, by):
                at = np.flatnonzero(c)
                l += [x] * len(at)
                b += at.tolist()
                n += c[at].tolist()
            return {"l": l, "b": b, "n": n}

        place = {x: k for k, x in enumerate(found)}
        for r in map_batches(texts, count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toLocalIterator():
            seen[place[r.l], r.b] = r.n
    return Profile(found, seen)


def _told(said: np.ndarray, right: float, names: list[str]) -> np.ndarray:
    """Log chances that each class gives what was said; none where that is no known language."""
    out = np.where(said[:, None] == np.array(names)[None, :], math.log(right), math.log((1 - right) / max(1, len(names) - 1)))
    return np.where(np.isin(said, names[:-1])[:, None], out, 0.0)


def evidence(rows: DataFrame, profile: Profile) -> DataFrame:
    """rows: key, text, host, markup. Returns key, host, letters, own (log chances of each class by all
    but the prior) and share (the same as chances that sum to 1).

    Null texts, hosts and markup are empty and tell nothing; repeated rows are rows like any
    other; very long texts are read whole, in slices; an empty table gives no rows. Other columns are not read.
    """
    names = profile.languages

    def score(batch):
        ll, letters = likelihoods(bytes_of(batch.column(1)), profile.table)
        host = [(x or "").lower() for x in batch.column(2).to_pylist()]
        markup = np.array([(x or "").lower().partition("-")[0] for x in batch.column(3).to_pylist()])
        suffix = np.array([SUFFIXES.get(x.rpartition(".")[2], "") if "." in x else "" for x in host])
        own = TEMPER * ll + _told(markup, DECLARED, names) + _told(suffix, SUFFIXED, names)
        share = np.exp(own - own.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        return {"key": batch.column(0), "host": host, "letters": letters, "own": list(own), "share": list(share)}

    return map_batches(rows.select("key", "text", "host", "markup"), score, "key string, host string, letters long, own array<double>, share array<double>")


def fuse(found: DataFrame, profile: Profile) -> DataFrame:
    """found: as evidence() gives it. Returns key, lang, posterior, accepted.

    Rows of no known language are not accepted, nor are rows without letters, as their
    text is no evidence; a short text that two known languages share is. Rows without a
    host share one. With no language to tell, lang is null and all are accepted. Of
    languages of equal chance the first by name is told. Repeated rows count each in the
    priors and are each returned; an empty table gives none.
    """
    names = profile.languages
    if len(names) == 1:
        return found.select("key", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(True).alias("accepted"))
    k, levels = len(names), [("suffix", F.substring_index("host", ".", -1)), ("domain", F.substring_index("host", ".", -2)), ("host", F.col("host"))]
    rows = materialize(found)
    sums = [F.sum(F.get("share", F.lit(j))).alias(f"s{j}") for j in range(k)]
    by_host = rows.where("letters > 0").groupBy("host").agg(*sums).select(*[c.alias(n) for n, c in levels], F.array(*[f"s{j}" for j in range(k)]).alias("share"))
    total = [x or 0.0 for x in by_host.agg(*sums).first()]
    top = F.array(*[F.lit((x + 1 / k) / (sum(total) + 1)) for x in total])
    prior = None
    for at, (name, _) in enumerate(levels):
        keys = [n for n, _ in levels[: at + 1]]
        own = by_host.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"s{j}" for j in range(k)]).alias("n"))
        own = own.withColumn("above", top) if prior is None else own.join(prior.withColumnRenamed("prior", "above"), keys[:-1])
        size = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) + STRENGTH
        prior = own.withColumn("size", size).select(*keys, F.zip_with("n", "above", lambda n, p: (n + STRENGTH * p) / F.col("size")).alias("prior"))
    # Rows of one host may be very many: they stay where they are if the hosts are few, and else Spark can split them, as both sides are exchanges.
    fused = rows.join(small_side(materialize(prior.select("host", "prior"))), "host", "left")
    logs = F.zip_with("own", F.coalesce("prior", top), lambda o, p: o + F.log(p))
    fused = fused.select("key", "letters", logs.alias("logs")).withColumn("most", F.array_max("logs"))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("logs", F.col("most")).cast("int"))
    posterior = F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    out = fused.select("key", "letters", best.alias("lang"), posterior.alias("posterior"))
    return out.select("key", "lang", "posterior", ((F.col("letters") > 0) & (F.col("lang") != UNKNOWN)).alias("accepted"))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Documents as rows of evidence: the source stands for the host; markup only if the text is a page.

    Null ids give null keys, null texts are empty, null sources are one host; each row gives one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("string").alias("key"), text.alias("text"), F.col(source_col).cast("string").alias("host"), _markup(text).alias("markup"))


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as rows of evidence: text without markup, host of the address, declared language.

    What is opened and never closed goes up to the end, so each part of a page is read once. Null pages
    are empty texts; addresses that are null or cannot be read have no host; each row gives one."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*(?:>.*?(?:</\1[^>]*(?:>|\z)|\z)|\z)|<(?=[a-z/!?])[^>]*(?:>|\z)|&#?[a-z0-9]+;", " ")
    return pages.select(F.col(id_col).cast("string").alias("key"), text.alias("text"), F.try_parse_url(F.col(url_col).cast("string"), F.lit("HOST")).alias("host"), _markup(html).alias("markup"))


def _markup(html: Column) -> Column:
    found = F.regexp_extract(html, r"""(?i)<html\b[^<>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    return F.when(F.substring(F.ltrim(html), 1, 1) == "<", F.lower(found)).otherwise(F.lit(""))


def identify(docs: DataFrame, profile: Profile | None = None, id_col: str = "doc_id") -> DataFrame:
    """key (the id as text), lang, posterior and accepted of every document, as fuse() gives them; odd rows are as in document_rows() and evidence()."""
    profile = profile or train(docs)
    return fuse(evidence(document_rows(docs, id_col), profile), profile)
