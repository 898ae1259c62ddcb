"""The pipeline against its stages in plain code, on the smallest table and odd rows."""

import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxgauge.llm import mixing, quality_rules
from fluxgauge.llm.queries import tokenizer_path
from tests.llm.test_llm_operators import jaccard_classes, plain_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that stages use themselves.
CLASHES = ["ids", "decoded", "round_trip", "row", "id", "th", "kept", "copies"]


def documents(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [tuple(r) for r in given]
    good = next(r for r in sorted(given, key=lambda r: r.doc_id) if len(r.text or "") > 2000)
    words = good.text.split(" ")
    rows += [
        (90001, None, "en", "a", None),
        (90002, "", None, None, 0),
        (90003, good.text.replace(" ", "  "), None, None, None),  # an exact copy
        (90004, " ".join(words[:-1]), "en", None, 1),  # a near copy
        (None, " ".join(words[1:]), "en", "a", 1),  # a near copy without an id
        (90005, "# | # |" * 500, "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df.repartition(3)


def plainly(spark, docs):
    """Copies per document and its text, each stage on what the one before it kept."""
    verdict = {r.doc_id: r.kept for r in quality_rules.judged(docs).collect()}
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert not any(verdict[r.doc_id] and plain_rules(r.text)[-1] for r in rows)
    rows = [r for r in rows if verdict[r.doc_id]]

    seen, once = set(), []
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if norm not in seen:
            seen.add(norm)
            once.append(r)
    classes = jaccard_classes([r.text for r in once], 5, 80, 100)
    apart = [r for i, r in enumerate(once) if classes[i][1] == i]
    assert len(rows) > len(once) > len(apart) > 50
    mix = mixing.mixed(spark.createDataFrame(apart, docs.schema)).collect()
    copies = {(None if r.id == 2**63 - 1 else r.id): r.copies for r in mix}
    return {r.doc_id: (copies[r.doc_id], r.text) for r in apart if copies[r.doc_id]}


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = plainly(spark, docs)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == {i: n for i, (n, _) in want.items()}
    coder = Tokenizer.from_file(tokenizer_path())
    coder.no_truncation()
    coder.no_padding()
    for r in {r.doc_id: r for r in got}.values():
        assert r.text == want[r.doc_id][1] and r.round_trip_ is True
        assert r.ids_ == coder.encode(r.text, add_special_tokens=False).ids
        assert [r[c] for c in CLASHES] == [f"{k}:{'-' if r.doc_id is None else r.doc_id}" for k in range(len(CLASHES))]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "round_trip"] and out.count() == 0
