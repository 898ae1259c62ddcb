"""Mixing sources to target weights by Pareto order sampling of documents.

Every document first gets its certain whole copies. Then the documents of a source are ranked by
random odds divided by inclusion odds, ``U/(1-U) / (p/(1-p))`` with p the fraction of a copy that
is due, and the first ones get one copy more, until the words of the source come nearest to its
target: a sample of fixed size, in words, with unequal probabilities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.llm.tables import NO_ID, Stages, one_of, packed, public_id

WEIGHTS = (1, 2, 3)
MOST = 3
#: A fraction of a copy up to this is rounding.
NOISE = 1e-12
SEED = "mix"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """Adds ``target`` to ``(missing, source, source_size)``, one row per source.

    Sources in code point order, the missing one last, weigh ``weights`` in turn and share
    ``share`` of all words. A target stops at ``most`` times its source; the rest is shared anew
    by weight. In order of cap per weight, the level at which all words are dealt is the largest
    of ``(total - caps before) / weights from here on``. The windows are over sources only.
    """
    nth = F.row_number().over(Window.orderBy("missing", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    cap = most * F.col("source_size").cast("double")
    step = sizes.withColumn("weight", weight).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "missing", "source")
    ahead = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double") * share
    step = step.withColumn("level", (total - ahead) / rest)
    step = step.withColumn("level", F.max("level").over(everything))
    return step.select("missing", "source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts: the same in every run."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def odds(p: Column) -> Column:
    return p / (1.0 - p)


def mixed(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weight: str | None = None,
    weights=WEIGHTS,
    share: float = 1.0,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """``(id, th, size, source_size, target, copies)`` per document.

    ``size`` counts words; null texts have none, get no copies beyond the certain ones, and are
    harmless. ``weight`` names a column of positive relevance: expected copies are in proportion to
    it, at most ``most``. Rows equal in id and size have equal ranks; which of them is taken makes
    no difference. A missing source is a source of its own. An empty table gives an empty result.

    The rank is cut into about as many buckets as a bucket has rows, so that finding the cut needs
    no task that sees a whole source: sums per bucket first, then the rows of one bucket a source.
    Documents due a whole number of copies have no part in the cut and lie in all buckets.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    relevance = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1e-9))
    rows = stages.put(
        docs.select(
            F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
            F.xxhash64(body).alias("th"),
            F.col(source).isNull().alias("missing"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
            F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            relevance.alias("relevance"),
        )
    )
    sums = rows.groupBy("missing", "source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.col("size") * F.col("relevance")).alias("relevant"),
        F.count("*").alias("n"),
    )
    sums = stages.put(sums)
    plan = targets(sums.select("missing", "source", "source_size"), weights, share, most)
    plan = stages.put(plan.join(sums.select("missing", "source", "relevant", "n"), ["missing", "source"]))
    buckets = max(16, math.isqrt(plan.agg(F.sum("n")).first()[0] or 0))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = F.least(
        F.lit(float(most)),
        F.when(F.col("relevant") > 0, F.col("relevance") * F.col("target") / F.col("relevant")).otherwise(0.0),
    )
    ranked = (
        rows.join(plan, ["missing", "source"])
        .withColumn("due", due)
        .withColumn("whole", F.floor("due"))
        .withColumn("p", F.col("due") - F.col("whole"))
        .withColumn("drawn", F.col("p") > NOISE)
        .withColumn("usual", F.greatest(rate - F.floor(rate), F.lit(1e-9)))
        .withColumn("u", uniform(F.lit(seed), F.col("id").cast("string"), F.col("size").cast("string")))
        .withColumn("odds", F.when(F.col("drawn"), odds(F.col("u")) / odds(F.col("p")) * odds(F.col("usual"))))
        # Back to a number in (0, 1): uniform where all documents of a source are due alike.
        .withColumn("rank", F.when(F.col("odds").isNotNull(), F.col("odds") / (1.0 + F.col("odds"))).otherwise(F.col("u")))
        .withColumn("bucket", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets)).cast("int"))
        .select("id", "th", "missing", "source", "size", "source_size", "target", "whole", "drawn", "rank", "bucket")
    )
    ranked = stages.put(ranked)
    per = ranked.groupBy("missing", "source", "bucket").agg(
        F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("here"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("goal")
    )
    own = Window.partitionBy("missing", "source")
    before = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = per.select(
        "missing",
        "source",
        "bucket",
        F.coalesce(F.sum("here").over(before), F.lit(0)).alias("ahead"),
        "here",
        (F.col("goal") - F.sum("certain").over(own)).alias("budget"),
    )
    placed = ranked.join(cuts, ["missing", "source", "bucket"])
    inside = F.col("ahead") + F.col("here") <= F.col("budget")
    beyond = F.col("ahead") > F.col("budget")
    # A copy is taken if it brings the words nearer to the budget: its middle lies within.
    running = F.sum("size").over(
        Window.partitionBy("missing", "source", "bucket")
        .orderBy("rank", "id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    at_cut = placed.where(F.col("drawn") & ~inside & ~beyond).withColumn(
        "extra", (F.col("ahead") + running - F.col("size") / 2 <= F.col("budget")).cast("long")
    )
    clear = placed.where(~F.col("drawn") | inside | beyond).withColumn("extra", (F.col("drawn") & inside).cast("long"))
    extra = F.when(F.col("whole") < most, F.col("extra")).otherwise(0)
    return clear.unionByName(at_cut).select(
        "id", "th", "size", "source_size", "target", (F.col("whole") + extra).cast("long").alias("copies")
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    found = mixed(docs, **options)
    return found.select(
        public_id("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns, whatever their names.

    Of rows equal in id and text the smallest by all columns is copied for all of them.
    """
    per = mixed(docs, **options).groupBy("id", "th").agg(F.sum("copies").alias("copies"))
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(packed(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(body).alias("th"))
    once = rows.groupBy("id", "th").agg(one_of(docs))
    taken = once.join(per.where("copies > 0"), ["id", "th"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
