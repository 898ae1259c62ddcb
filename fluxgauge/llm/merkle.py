"""A Merkle manifest of documents: one tree per source, one tree over the sources.

Every level is one table of nodes ``(sid, idx, n)``: tree, position within the level and number
of nodes there. A level meets itself once per sibling: sibling positions are computed (XOR for
binary trees, offsets of the slot otherwise) and joined by equality. Rows of slot zero, which then
know their whole run, emit the parents. Proofs run back down: a node's proof is its siblings
followed by the proof of its parent, so only neighbouring levels are ever joined.

No tree, source or level is held by one task: leaves are numbered by a range partitioning and
counts per (partition, source), and every join key of a level contains the position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.llm.tables import Stages

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: One step of a proof: digests left and right of a node within its run.
_STEP = "array<struct<before:binary,after:binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    """SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _none() -> Column:
    return F.lit(b"")


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of ``-`` per null and ``length:value`` per other value, the length in UTF-8 bytes."""
    texts = [c.cast("string") for c in columns]
    shown = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return _hash(F.concat(*shown))


def _numbered(rows: DataFrame, group: str, order: list[str], stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Rows as stored in the order (group, order) with their place ``seq`` there, and per (partition,
    group) how its rows go on the group: ``(part, group, first, ahead, n)``.

    The first table has one row per row, the second one per partition and group in it.
    """
    placed = (
        rows.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("seq", F.monotonically_increasing_id())
        .withColumn("part", F.shiftrightunsigned("seq", 33))
    )
    placed = stages.put(placed)
    runs = placed.groupBy("part", group).agg(F.min("seq").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy(group)
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "part",
        group,
        "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"),
        F.sum("rows").over(own).alias("n"),
    )
    return placed, stages.put(runs)


def _positions(placed: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """``idx`` within the group, and the other columns of ``runs``, for every stored row."""
    named = runs.withColumnsRenamed({"part": "run_part", group: "run_group"})
    same = (F.col("part") == F.col("run_part")) & F.col(group).eqNullSafe(F.col("run_group"))
    joined = placed.join(named, same).withColumn("idx", F.col("seq") - F.col("first") + F.col("ahead"))
    return joined.drop("run_part", "run_group", "part", "seq", "first", "ahead")


def _siblings(arity: int) -> list[Column]:
    """Positions of the other members of a node's run; the j-th follows the node by j, cyclically."""
    idx = F.col("idx")
    if arity == 2:
        return [idx.bitwiseXOR(F.lit(1))]
    slot = idx % arity
    return [idx - slot + (slot + j) % arity for j in range(1, arity)]


def _level(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the digests ``before`` and ``after`` them in their run, each in order."""
    out, before, after = nodes, [], []
    other = nodes.select(F.col("sid").alias("o_sid"), F.col("idx").alias("o_idx"), F.col("digest").alias("other"))
    for j, at in enumerate(_siblings(arity)):
        out = out.withColumn(f"at{j}", at)
        side = other.withColumnRenamed("other", f"other{j}")
        out = out.join(side, (F.col("sid") == F.col("o_sid")) & (F.col(f"at{j}") == F.col("o_idx")), "left").drop("o_sid", "o_idx")
        smaller = F.col(f"at{j}") < F.col("idx")
        before.append(F.coalesce(F.when(smaller, F.col(f"other{j}")), _none()))
        after.append(F.coalesce(F.when(~smaller, F.col(f"other{j}")), _none()))
    return out.select(*nodes.columns, F.concat(*before).alias("before"), F.concat(*after).alias("after"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level, from the nodes in slot zero."""
    return level.where((F.col("n") > 1) & (F.col("idx") % arity == 0)).select(
        "sid",
        F.expr(f"idx div {arity}").alias("idx"),
        F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        _hash(F.concat(_hex(F.col("digest")), _hex(F.col("after")))).alias("digest"),
    )


def grown(leaves: DataFrame, stages: Stages, arity: int = 3) -> list[DataFrame]:
    """All levels of the trees over ``leaves(sid, idx, n, digest, ...)``, leaves first.

    ``n`` is the number of leaves of the tree. Columns beyond these four stay with the leaves.
    A level's ``n`` is 1 where its node is the root. An empty table gives one empty level.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    widest = leaves.agg(F.max("n")).first()[0] or 1
    levels = [stages.put(_level(leaves, arity))]
    while widest > 1:
        widest = -(-widest // arity)
        levels.append(stages.put(_level(_parents(levels[-1], arity), arity)))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``(level, sid, top)``: the root of every tree and the level it is on."""
    parts = [
        level.where("n = 1").select(F.lit(k).alias("level"), "sid", F.col("digest").alias("top"))
        for k, level in enumerate(levels)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def proved(levels: list[DataFrame], tops: DataFrame, arity: int = 3) -> DataFrame:
    """The leaves with ``steps``, their proof, and whatever ``tops`` tells about their tree.

    ``tops`` has ``level``, ``sid`` and ``steps`` (what follows behind the tree's root), one row per
    tree; its other columns are handed down.
    """
    told = [c for c in tops.columns if c not in ("level", "sid", "steps")]
    below = None
    for k in range(len(levels) - 1, -1, -1):
        own = [c for c in levels[k].columns if c not in ("n", "before", "after")]
        here = tops.where(F.col("level") == k).drop("level")
        ends = levels[k].where("n = 1").join(here, "sid").select(*own, "steps", *told)
        if below is not None:
            up = below.select(F.col("sid").alias("p_sid"), F.col("idx").alias("p_idx"), F.col("steps").alias("rest"), *told)
            inner = levels[k].where("n > 1").withColumn("parent", F.expr(f"idx div {arity}"))
            inner = inner.join(up, (F.col("sid") == F.col("p_sid")) & (F.col("parent") == F.col("p_idx")))
            step = F.array(F.struct("before", "after")).cast(_STEP)
            ends = ends.unionByName(inner.select(*own, F.concat(step, "rest").alias("steps"), *told))
        below = ends
    return below


def folded(digest: Column, steps: Column) -> Column:
    """The root as lowercase hex that a leaf digest and its proof lead to."""
    return F.aggregate(
        steps,
        _hex(digest),
        lambda h, s: F.sha2(F.concat(_hex(s["before"]), h, _hex(s["after"])), 256),
    )


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all digests of a proof as hex, leaf to root, left to right."""
    both = F.transform(steps, lambda s: F.concat(s["before"], s["after"]))
    return F.sha2(F.array_join(F.transform(both, _hex), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = 3) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row of ``docs``.

    Leaves are ordered by ``doc_id`` within their source, subroots by source, bytewise; missing
    sources and ids come first. ``tampered`` is the text as found later (default: as it is): the
    leaf is computed again from it and folded with the stored proof, and ``verified`` tells whether
    that gives the root. Of rows with equal source and id the smaller leaf digest comes first, and
    equal rows are interchangeable leaves, each with a place of its own. Empty texts differ from
    missing ones. An empty table gives an empty result. Columns beyond the five are not read.
    """
    stages = Stages(docs.sparkSession)
    values = [F.col(c) for c in FIELDS]
    later = values[:-1] + [F.col("text") if tampered is None else tampered]
    rows = stages.put(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            leaf_digest(values).alias("digest"),
            leaf_digest(later).alias("later"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    placed, runs = _numbered(rows, "source", ["doc_id", "digest", "row"], stages)
    sources = runs.groupBy("source").agg(F.first("n").alias("n_leaves"))
    held, spread = _numbered(sources.withColumn("all", F.lit(0)), "all", ["source"], stages)
    order = _positions(held, spread, "all").select(
        F.col("source").alias("known"), F.col("idx").alias("sid"), F.col("n").alias("n_sources")
    )
    order = stages.put(order)
    numbered = runs.join(order, F.col("source").eqNullSafe(F.col("known"))).drop("known", "n_sources")
    leaves = _positions(placed, stages.put(numbered), "source").drop("row", "source")

    levels = grown(stages.put(leaves), stages, arity)
    tops = stages.put(roots(levels))
    # The subroots are the leaves of the upper tree: a source's number is its place there.
    heads = tops.join(order.select("sid", "n_sources"), "sid").select(
        F.lit(0).cast("long").alias("sid"),
        F.col("sid").alias("idx"),
        F.col("n_sources").alias("n"),
        F.col("top").alias("digest"),
        F.col("level").alias("found"),
    )
    upper = grown(stages.put(heads), stages, arity)
    summit = roots(upper).select("level", "sid", F.array().cast(_STEP).alias("steps"), F.col("top").alias("root"))
    above = proved(upper, stages.put(summit), arity).select(
        F.col("found").alias("level"), F.col("idx").alias("sid"), "steps", F.col("digest").alias("subroot"), "root"
    )
    out = proved(levels, stages.put(above), arity)
    out = out.withColumn("folded_root", folded(F.col("later"), F.col("steps"))).select(
        "doc_id",
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == _hex(F.col("root"))).alias("verified"),
    )
    return stages.last(out)
