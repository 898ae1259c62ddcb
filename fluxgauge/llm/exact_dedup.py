"""Exact deduplication against a persistent digest index, by DataFrame operations alone.

The index is a table of 32-byte digests, bucketed and sorted by digest. New data is reduced to
one row per digest, joined with the index by a sort-merge anti-join (the index side is neither
shuffled nor re-dealt), and what is new is appended. Only digests and ids move, never texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.llm.tables import NO_ID, Stages, one_of, packed, public_id
from fluxgauge.session import scratch_path

BUCKETS = 32


class DigestIndex:
    """A bucketed table ``(digest, keep_id)`` at a path of the shared store.

    The number of buckets belongs to the stored data: reopen a path with the number it was made
    with. Appends add files to buckets; `compact` makes them one again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "digests")
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame) -> None:
        """Append the rows of ``digests(digest, keep_id)``, one per digest, that the index lacks.

        Adding the same rows again changes nothing, so a job that died may be run once more.
        """
        fresh = digests.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self, path: str) -> "DigestIndex":
        """A copy of the index with one sorted file per bucket."""
        other = DigestIndex(self.spark, path, self.buckets)
        other.add(self.read())
        return other


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, digest)``: SHA-256 of the text with every run of white space as one space."""
    body = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.unhex(F.sha2(body, 256)).alias("digest")
    )


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` per row of ``docs``; extends the index.

    Of equal texts the row with the smallest id stays, unless the index already knows the text:
    then the row it names stays. ``group_size`` counts the rows of this batch. Null texts equal
    empty ones. A missing id counts as the largest; rows that repeat the id that stays are all
    marked kept. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = Stages(spark).put(digests(docs, text, doc_id))
    groups = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("group_size"))
    index.add(groups.select("digest", F.col("first_id").alias("keep_id")))
    named = groups.join(index.read(), "digest").select("digest", "keep_id", "group_size")
    return rows.join(named, "digest").select(
        public_id("id").alias("doc_id"),
        public_id("keep_id").alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def first_of_equal(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; of rows equal in id and
    text, the smallest by all columns."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = Stages(spark).put(digests(docs))
    index.add(rows.groupBy("digest").agg(F.min("id").alias("keep_id")))
    stay = rows.join(index.read(), "digest").where("id = keep_id").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    marked = docs.select(packed(docs), key.alias("_id"), F.unhex(F.sha2(body, 256)).alias("_digest"))
    kept = marked.join(stay, ["_id", "_digest"], "left_semi").groupBy("_id", "_digest").agg(one_of(docs))
    return kept.select("row.*")
