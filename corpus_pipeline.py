"""A training-data pipeline: rules, exact and near copies, source mix, tokens.

Every stage reads what its predecessor wrote, as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxgauge.llm import bpe, exact_dedup, jaccard_join, mixing, quality_rules
from fluxgauge.llm.queries import tokenizer_path
from fluxgauge.llm.tables import Stages, documents

#: Tokens and random ranks have no SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.first_of_equal(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, 80 % alike."""
    return jaccard_join.one_per_class(docs, shingle=5, similarity=(80, 100))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text.

    The new columns are ``ids`` and ``round_trip``, with an underscore more where the documents have
    columns of these names.
    """
    path = tokenizer_path()
    ids, back, same = (_free(name, docs) for name in ("ids", "decoded", "round_trip"))
    coded = bpe.decoded(bpe.encoded(docs, path, ids=ids), path, ids=ids, text=back)
    alike = coded[back].eqNullSafe(coded["text"]) | coded["text"].isNull()
    return coded.withColumn(same, alike).drop(back)


STAGES = [
    ("quality_rules", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("source_mix", source_mix),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows are not stored."""
    stages = Stages(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stages.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
