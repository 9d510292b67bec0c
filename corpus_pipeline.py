"""A corpus pipeline of five stages, each a call of one operator.

Each stage takes (spark, docs, sf_dir) with docs as the stage before left it; all but
the last return the columns of documents. Decisions are about rows, not about ids: a row
is named by its id and a hash of all its columns, so rows that share an id or have none
are judged each by itself, and only rows that are alike in every column share a fate
(of those that are near-duplicates one stays). Null and empty texts have no letters, so the
language stage drops them; in the stages after it they would be kept, once. Very long
texts are read in full by every stage; an empty table stays empty. Among near-duplicates
the smallest id stays, of equal ids the row of smallest hash. Extra columns are carried
along, whatever they are called.

ORACLE_SQL is None, as SQL expresses neither the language model nor the fingerprints;
tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm import bpe, decontaminate, language, pii, simhash
from pagequarry.llm.common import collecting, discard, materialize, read, small_side
from pagequarry.llm.queries import vocabulary


def _row_key(docs: DataFrame) -> Column:
    """Whether the id is absent, the id, and 128 bits of hash of all columns, in this order."""
    told = [x for f in docs.schema for x in (F.col(f.name).isNull(), F.col(f.name) if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(f.name)))]
    own = F.col("doc_id").cast("long")
    return F.struct(own.isNull().alias("absent"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(*told).alias("a"), F.xxhash64(F.lit(1), *told).alias("b"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the row key, and the name of its column, which no other has."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, _row_key(docs)), name


def _without(docs: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """Rows but for those with the keys, which are broadcast only if a count shows that they are few."""
    gone = materialize(keys.select(F.col(keys.columns[0]).alias(name)).distinct())
    return docs.join(small_side(gone), name, "left_anti")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is of no language that the labels know, or without letters."""
    rows, name = _keyed(docs)
    found = language.identify(rows, id_col=name)
    return _without(rows.withColumn(name, F.col(name).cast("string")), name, found.where("not accepted").select("key")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest key of each group; of rows that are alike in all columns, one."""
    rows, name = _keyed(docs)
    found = materialize(simhash.near_duplicates(rows, id_col=name))
    kept = _without(rows, name, found.where("doc_id <> component_id").select("doc_id"))
    repeated = materialize(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name)))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, name, "left_semi").dropDuplicates([name])
    return kept.join(repeated, name, "left_anti").unionByName(once).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item or an edited copy of one."""
    rows, name = _keyed(docs)
    found = decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"), id_col=name)
    return _without(rows, name, found.select("doc_id")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and counts the characters again."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, *vocabulary(), with_ids=True)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", redact),
    ("tokens", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written and read again.

    What a stage wrote is deleted when its result is; the table that the last stage reads stands until discard_all().
    """
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with collecting() as made:
            before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(*[t for t in made if t is not docs], *([before] if k else []))
    return STAGES[-1][1](spark, docs, sf_dir)
