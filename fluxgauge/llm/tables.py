"""Tables shared by the operators: keyed documents, staged intermediates, the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A missing id sorts behind every other one.
NO_ID = 2**63 - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, th, text)``: the id (missing ones last), a hash of the text, and the text (null: empty).

    ``(id, th)`` names a row for joins: rows that agree in both are the same document.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(body).alias("th"),
        body.alias("text"),
    )


def public_id(column: str) -> F.Column:
    """The id as given: the marker of a missing one is null again."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def packed(docs: DataFrame) -> F.Column:
    """All columns of a row as one struct ``row``, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def one_of(docs: DataFrame) -> F.Column:
    """Aggregate: the smallest ``row`` of a group; any one if a column (a map) has no order."""
    ordered = "map<" not in docs.schema.simpleString()
    return (F.min if ordered else F.first)("row").alias("row")


class Stages:
    """Intermediate tables in the shared folder, deleted when no longer needed.

    A table is written once and read back, so a lost executor never costs more than the stage it
    worked on, and the shuffle files of a finished stage go at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "stage")
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self._paths.pop(id(table))
            delete(self.spark, path)

    def last(self, *results: DataFrame):
        """Store the results themselves and delete every other table; one result comes alone."""
        others = [table for table, _ in self._paths.values()]
        out = tuple(self.put(df) for df in results)
        self.drop(*others)
        return out if len(out) > 1 else out[0]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
