"""A node table that is parsed and written once, and read by tag or class.

Nodes go, without a shuffle, to Parquet files sorted by tag, each document's running text with
its document node. The mentions of classes go to files sorted by class when a class is first asked for. Readers' filters on name or class reach the files, whose statistics skip what
has other tags; columns that are not named are not read. Tables stand in the shared folder
until discard(), so every use of the store shares one parse, and lost executors read
again instead of parsing again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from . import nodes as N
from .extract import html_nodes

_PLACES = ("node_id", "parent_id", "sibling_ord", "element_ord", "pre", "post", "depth", "name", "ns", "text_from", "text_to")
GROUP_BYTES = 8 << 20  # of a row group, so that tags lie in groups of their own


@dataclass(frozen=True)
class NodeStore:
    spark: SparkSession
    path: str
    doc: str

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    @property
    def nodes(self) -> DataFrame:
        """All nodes, with the columns of html_nodes(); filters on name and kind skip files' parts."""
        return self._read("nodes")

    @property
    def texts(self) -> DataFrame:
        """doc and text: all text nodes of each document, in order."""
        return self.nodes.where("kind = 'document'").select(self.doc, F.col("running").alias("text"))

    def by_tag(self, *names: str) -> DataFrame:
        wanted = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in n) for n in names]
        return self.nodes.where((F.col("kind") == "element") & F.col("name").isin(*wanted))

    def by_class(self, name: str) -> DataFrame:
        """Places of the elements of a class, once for each mention of it."""
        try:
            mentions = self._read("classes")
        except AnalysisException:  # not asked for before
            mentions = self.nodes.where("kind = 'element'").select(F.explode(N.classes()).alias("class"), self.doc, *_PLACES)
            _write(mentions.sortWithinPartitions("class", self.doc, "pre"), f"{self.path}/classes")
            mentions = self._read("classes")
        return mentions.where(F.col("class") == name).drop("class")

    def text_content(self, context: DataFrame) -> DataFrame:
        return N.text_content(self.nodes, context, self.doc, self.texts)

    def discard(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def store_nodes(pages: DataFrame, id_col: str, html_col: str) -> NodeStore:
    """Parses pages once. Null pages have no nodes and no text; an empty table gives empty tables; rows that
    share an id share a document's name, so ids must differ where axes are used."""
    spark = pages.sparkSession
    store = NodeStore(spark, f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}", id_col)
    nodes = html_nodes(pages, id_col, html_col)
    _write(nodes.sortWithinPartitions("name", "kind", id_col, "pre"), f"{store.path}/nodes")
    return store


def _write(df: DataFrame, path: str) -> None:
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
