"""Columns of the caller stay as they are, whatever they are called; verification goes in parts."""

import pytest
from pyspark.sql import functions as F

from fluxgauge.llm import exact_dedup, jaccard_join, mixing
from fluxgauge.llm.tables import Stages

NAMES = ["_id", "_th", "_digest", "id_", "th_", "_copies", "_copy", "_rows", "row", "id", "th", "copies", "copy", "kept", "digest", "node", "a.b"]

BASE = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, BASE, "s", None), (2, BASE, None, 5), (3, BASE + " more", "s", 6), (4, "something else said here once", "t", 7),
    (5, None, "t", 8), (5, None, "t", 8), (6, "", None, None), (None, "no id but words in it", "s", 1), (4, "something else said here once", "t", 2),
]


def wide(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long").withColumn("lang", F.lit("en"))
    for k, name in enumerate(NAMES):
        df = df.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df


@pytest.mark.parametrize("operator", [exact_dedup.first_of_equal, jaccard_join.one_per_class, mixing.mixed_documents])
def test_columns_of_users_are_untouched(spark, operator):
    df = wide(spark)
    out = operator(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{k}:{'-' if r.doc_id is None else r.doc_id}" for k in range(len(NAMES))]
    plain = operator(df.drop(*[f"`{n}`" if "." in n else n for n in NAMES])).select("doc_id", "text", "source")
    assert sorted(map(str, plain.collect())) == sorted(map(str, out.select("doc_id", "text", "source").collect()))


def test_of_rows_that_differ_elsewhere_the_smallest_stays(spark):
    df = wide(spark)
    for operator in (exact_dedup.first_of_equal, jaccard_join.one_per_class):
        assert [r.n_chars for r in operator(df).where("doc_id = 4").collect()] == [2]
    mapped = df.withColumn("m", F.create_map(F.lit("k"), F.col("n_chars")))
    assert exact_dedup.first_of_equal(mapped).count() == exact_dedup.first_of_equal(df).count()


def test_parts_of_the_pairs_give_all_links(spark, monkeypatch):
    rows = [(k, " ".join(f"w{j}" for j in range(40) if j != k % 11), "s", 1) for k in range(30)]
    rows += [(100 + k, " ".join(f"v{k}x{j}" for j in range(30)), "s", 1) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = []
    for parts in (1, 3, 8):
        monkeypatch.setattr(jaccard_join, "VERIFY_PARTS", parts)
        found.append(sorted(map(tuple, jaccard_join.component_report(df, shingle=3, similarity=(60, 100)).collect())))
    assert found[0] == found[1] == found[2]
    assert len({r[2] for r in found[0]}) == 7


def test_only_the_result_stays_stored(spark, monkeypatch):
    left = []
    last = Stages.last
    monkeypatch.setattr(Stages, "last", lambda self, *df: (last(self, *df), left.append(len(self._paths)))[0])
    df = spark.createDataFrame([(1, BASE), (2, BASE + " x"), (3, "b c d e f")], "doc_id long, text string")
    assert jaccard_join.component_report(df).count() == 3
    assert left == [1]
