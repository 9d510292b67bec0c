"""Lines that many documents share: of each, only the last document keeps its copies.

Texts are cut at line feeds. A line's key is the line without white space at its ends, A-Z
lower-cased. Keys of at least min_chars code points go by 128 bits of hash into one table of
occurrences (row, position, hash), which is written once; documents are counted for each
hash, hashes of at least min_docs documents lose their lines except in the document of
largest id, and what is left of each text is put together by position. All of it is
DataFrame functions; no Python runs in the tasks.

Movement: a line travels as its hash and position, never as text. Counting distinct
documents combines before each of its two shuffles, so a line that is everywhere is no hot
key. Shared hashes, and then rows that lose lines, are broadcast only if a count shows that
they are few; beyond that the texts are shuffled once to meet their lost positions.

Odd rows: a null or empty text is one empty line. Rows that share an id are one document
for the counts, and each keeps its own text; alike rows all come back. Rows of null id are
no document: they count for none, and lose the lines that others share. Very long texts are
read whole; an array of their lines must fit a task. Of equal ids nothing else decides, as
all lines of the largest id stay. Other columns of docs are not read, whatever they are
called. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, keyed, materialize, small_side

MIN_CHARS, MIN_DOCS = 40, 5
BLANK = " \t\n\x0b\x0c\r"  # what is cut off at both ends of a line
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _two(*columns: Column) -> tuple[Column, Column]:
    """128 bits of hash, so that even over all lines of a crawl no two different ones agree."""
    return F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")


def occurrences(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Row hash (a, b), doc_id, position and line hash (u, v) of each line of rows(doc_id, text, a, b) whose key is long enough."""
    lines = rows.select("doc_id", "a", "b", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.char_length("line") >= min_chars)
    u, v = _two(F.translate("line", UPPER, LOWER))
    return keys.select("doc_id", "a", "b", "pos", u.alias("u"), v.alias("v"))


def shared_lines(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Line hashes of at least min_docs documents, and the largest doc_id of each."""
    counts = found.groupBy("u", "v").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    return counts.where(F.col("n") >= min_docs).select("u", "v", "keeper")


def _rest(lines: Column, gone: Column) -> Column:
    """The lines between the positions of gone, which are in order: one slice for each gap, so the cost is linear."""
    start = lambda k: F.coalesce(F.get(gone, k - 1) + 1, F.lit(0))
    end = lambda k: F.coalesce(F.get(gone, k), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text without shared lines, n_lines before, n_dropped; one row for each row of docs."""
    rows = bounded(keyed(docs, id_col, text_col)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *_two(F.col("doc_id"), F.col("text")))
    found = materialize(occurrences(rows, min_chars))
    shared = materialize(shared_lines(found, min_docs))
    lost = found.join(small_side(shared), ["u", "v"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = materialize(lost.groupBy("a", "b").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    size = lost.agg(F.coalesce(F.sum(F.size("gone") + 1), F.lit(0))).first()[0]
    out = rows.join(F.broadcast(lost) if size <= BROADCAST_ROWS else lost, ["a", "b"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_rest(F.col("lines"), F.col("gone")), "\n"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select("doc_id", kept.alias("text"), count("lines").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(count("gone")).alias("n_dropped"))


def digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left; odd rows as in dedup_lines."""
    return dedup_lines(docs, **kw).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
