"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages.
STOP_WORDS = [
    *["the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "was", "are", "this", "from", "by"],
    *["der", "die", "das", "und", "von", "den", "mit", "ist", "ein", "eine", "für", "auf", "sich", "dem", "als"],
    *["le", "la", "les", "des", "et", "de", "un", "une", "que", "est", "dans", "pour", "par", "avec", "du"],
    *["el", "los", "las", "y", "en", "con", "por", "para", "del", "se", "su", "al", "lo"],
]

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

#: (measure, lowest, highest) that a document must keep to; None is no bound.
BASE: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("repeat_ratio", None, 0.5),
]
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 16.0),
    ("symbol_ratio", None, 0.1),
    ("dup_line_ratio", None, 0.5),
    ("n_stop_words", 2, None),
]


def _length_without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, the counts of every text, and the ratios that thresholds are set on.

    Words are runs of characters other than 0x20 and 0x09-0x0D; ``word_chars`` are code points. A
    duplicate line has a word and equals an earlier line. A repeated word lies in a three-word
    window found twice or more in the text. Null and empty texts have zero counts and ratios.
    Repeated rows are judged one by one, a missing id stays missing, other columns are not read.

    Every step is a projection of one row. Windows are compared as strings; where some repeat,
    they are sorted, so that equal ones are neighbours: the cost stays n log n.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    step = step.select(
        "doc_id",
        "body",
        F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    window = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    step = step.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _length_without(F.col("body"), WHITE).cast("long").alias("word_chars"),
        (F.length("body") - _length_without(F.col("body"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect(F.transform(F.array_distinct("words"), F.lower), F.array(*map(F.lit, STOP_WORDS))))
        .cast("long")
        .alias("n_stop_words"),
        F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)).alias("windows"),
    )
    counts = [c for c in step.columns if c != "windows"]
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    entries = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    step = step.select(*counts, F.when(repeats, F.sort_array(entries)).alias("ranked"))
    at = lambda k: F.get("ranked", k)["w"]
    twice = F.filter(
        F.sequence(F.lit(0), F.size("ranked") - 1), lambda k: (at(k) == at(k - 1)) | (at(k) == at(k + 1))
    )
    starts = F.sort_array(F.transform(twice, lambda k: F.get("ranked", k)["i"]))
    step = step.select(*counts, F.when(F.col("ranked").isNotNull(), starts).alias("starts"))
    covered = F.aggregate(
        F.coalesce("starts", F.array().cast("array<int>")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    step = step.select(*counts, covered.alias("n_repeat_words"))
    return step.select(
        "*",
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
    )


def keeps(thresholds) -> Column:
    """The threshold table as one condition."""
    ok = F.lit(True)
    for measure, low, high in thresholds:
        if low is not None:
            ok = ok & (F.col(measure) >= low)
        if high is not None:
            ok = ok & (F.col(measure) <= high)
    return ok


def judged(docs: DataFrame, thresholds=None, base=None, **columns) -> DataFrame:
    """`measured` with ``base_failed`` and ``kept``: within the base table, and within both tables."""
    base_ok = keeps(BASE if base is None else base)
    return measured(docs, **columns).withColumn("base_failed", ~base_ok).withColumn(
        "kept", ~F.col("base_failed") & keeps(THRESHOLDS if thresholds is None else thresholds)
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns.

    The row number keeps the filter above the projections: pushed below them, it would repeat
    their expressions within each other's loops.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    marked = judged(packed, doc_id="doc", **options).withColumn("row", F.monotonically_increasing_id())
    return marked.where("kept and row >= 0").select("doc_id.*")
