"""Large groups of near copies: few pairs are compared, and the classes are still those of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from fluxgauge.llm import jaccard_join
from fluxgauge.llm.tables import Stages, keyed
from tests.llm.test_llm_operators import jaccard_classes


def copies(n: int, words: int = 120, seed: int = 3) -> list[str]:
    """Near copies of one text, each with other words in some places, and some texts of their own."""
    rng = random.Random(seed)
    base = [f"w{j}" for j in range(words)]
    texts = []
    for k in range(n):
        own = list(base)
        for j in rng.sample(range(words), rng.randint(3, 12)):
            own[j] = f"x{k}y{j}"
        texts.append(" ".join(own))
    return texts + [" ".join(f"v{k}z{j}" for j in range(words)) for k in range(20)]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def classes(spark, texts, **options):
    rows = jaccard_join.linked_classes(table(spark, texts), shingle=2, similarity=(80, 100), **options).collect()
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_pairs_compared_in_a_group_are_few(spark, monkeypatch):
    compared = []
    verified = jaccard_join._verified
    monkeypatch.setattr(
        jaccard_join, "_verified", lambda pairs, *rest: (compared.append(pairs.count()), verified(pairs, *rest))[1]
    )
    texts = copies(160)
    assert classes(spark, texts) == jaccard_classes(texts, 2, 80, 100)
    assert 0 < sum(compared) < 160 * 159 / 2 / 4


@pytest.mark.parametrize("small,region,batch", [(256, 4096, "10000"), (256, 4096, "7"), (8, 4096, "5"), (8, 9, "10000")])
def test_rounds_and_crowded_cells_lose_no_link(spark, monkeypatch, small, region, batch):
    monkeypatch.setattr(jaccard_join, "SMALL_CELL", small)
    monkeypatch.setattr(jaccard_join, "MORE_PARTNERS", 2)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        texts = copies(60, seed=int(batch))
        assert classes(spark, texts, region=region) == jaccard_classes(texts, 2, 80, 100)
    finally:
        spark.conf.set(key, before)


def test_only_texts_of_candidates_are_shuffled(spark):
    docs = keyed(table(spark, copies(40) + [None, "", "a"]))
    wanted = docs.where("id % 7 = 0").select("id", "th")
    passed = {r["id"] for r in jaccard_join._perhaps_in(docs, wanted).collect()}
    want = {r["id"] for r in wanted.collect()}
    assert want <= passed and len(passed) <= len(want) + 1
    assert jaccard_join._perhaps_in(docs, wanted.limit(0)).count() == 0
    assert jaccard_join._perhaps_in(docs, wanted).columns == docs.columns


def test_pivots_are_kept_once_per_set(spark, monkeypatch):
    """The table with bins and pivots of every document is dropped once distinct sets have them."""
    kept = []
    last = Stages.last
    monkeypatch.setattr(Stages, "last", lambda self, *df: (kept.extend(t.columns for t, _ in self._paths.values()), last(self, *df))[1])
    jaccard_join.linked_classes(table(spark, copies(5))).agg(F.count("*")).collect()
    assert sum("pivots" in c for c in kept) == 1


def test_near_copies_meet_in_few_cells(spark, monkeypatch):
    """Where the pivot before is the same too, a pair has met already: one cell per run of shared pivots."""
    rows = []
    put = Stages.put

    def counted(self, df):
        out = put(self, df)
        if {"cell", "node"} <= set(out.columns):
            rows.append(out.count())
        return out

    monkeypatch.setattr(Stages, "put", counted)
    words = [f"w{j}" for j in range(600)]
    texts = [" ".join(words), " ".join([*words[:300], "x", *words[300:]])]
    assert classes(spark, texts) == jaccard_classes(texts, 2, 80, 100)
    assert 2 <= sum(rows) <= 20  # of some 120 shared pivots
