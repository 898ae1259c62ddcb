"""Near-duplicate classes by an exact join in the Jaccard metric space.

Pivots partition the space into regions, the triangle inequality says which documents must also
be seen by a neighbouring region, and regions are joined recursively:

* First level. The pivots are the one-shingle sets ``{s}``, at distance ``1 - 1/|x|`` from every
  document x that has s and 1 from all others. A document lives in the cell of its first nearest
  pivot in one global order of shingles (common shingles last). Documents within distance
  ``1 - t`` miss at most ``(1-t)|x|`` of each other's shingles, so a window of the first
  ``floor((1-t)|x|) + 1`` pivots, to whose cells a document is replicated, loses no pair.
* In its first common cell a linked pair shares nothing ahead of the pivot, so the places of the
  pivot bound the intersection; a pair with the same pivot before has met in that one's cell. Members
  without a possible partner leave before anything wide is attached.
* Cells are joined by size windows, crowded ones recursively around document pivots
  (`region_pairs`), in the space of shingle counts per hash bin: their L1 distance never exceeds the
  symmetric difference of the sets, is a metric, and so bounds the Jaccard distance from below.
* For classes, cells are joined in rounds. Of a member's partners the first and the last in order of
  size go out, more in each round, and what is linked counts as one class from then on: a large class
  of near copies is tied together by few pairs of its members. A cell of which partners were held
  back comes again in the next round; the last round holds back none.
* Candidates are compared once more by counts in as many bins as their sizes call for, as 128 bins
  tell two long texts apart no longer, and the pairs left are verified on the whole shingle sets.

For classes only pairs that could join two of them are compared; no link between different classes
is lost, so the classes are those of all links. `linked_pairs` gives every link between different
sets, in one round and without labels. Equal sets are one point of the space.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.graph import linked_labels
from fluxgauge.llm.tables import NO_ID, Stages, keyed, one_of, packed, public_id
from fluxgauge.llm.text import buffer, lists, mix, slices, split_words, windows

BINS = 128
#: A shingle is common if it makes up this share of all shingles; so at most twice 2**18 are, 4 MB.
COMMON_SHARE = 2**-18
#: In how many documents at least.
COMMON_LEAST = 16
#: Cells up to this size are joined by size windows alone; larger ones are split around pivots.
SMALL_CELL = 256
#: Most members of a region that one task joins; larger ones are joined block against block.
REGION = 4096
#: Partners that a member sends out from either end in the first round, and how many times more in the next.
FIRST_PARTNERS, MORE_PARTNERS = 1, 8
#: Bits of the filter that texts pass on their way to the candidates: 2 MB, whatever the size of the corpus.
FILTER_BITS = 2**24
#: Parts in which candidate pairs are verified; the shuffle files of a part go before the next.
VERIFY_PARTS = 1
#: Shingles per bin of a wide sketch. Unrelated sets of n shingles differ there by some 0.6 n in sum.
BIN_LOAD = 4


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, flat, and their number per text."""
    words = split_words(*buffer(column), lower=True)
    grams = windows(words.hash, size)
    flat, counts = [], np.zeros(len(column), np.int64)
    for d in range(len(column)):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = windows(words.hash[a:b], b - a)
        else:
            continue
        flat.append(own)
        counts[d] = len(own)
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), counts


def common_shingles(docs: DataFrame, size: int, stages: Stages) -> np.ndarray:
    """Shingles with at least ``COMMON_SHARE / 2`` of all places, counted over every document.

    A task reports shingles with half of ``COMMON_SHARE`` in what it has read, so one with the
    whole share is reported by tasks that hold most of it. At most ``2 / COMMON_SHARE`` shingles
    can have such a count, whatever the size of the corpus: that bounds what is collected. The
    table only sets an order of shingles, so its precision has no influence on results.
    """

    def run(batches):
        waiting, total = [], 0

        def report():
            flat = np.concatenate(waiting)
            waiting.clear()
            flat.sort()
            # What comes at least so often is met again so many places later; the rest is never copied.
            step = max(2, math.ceil(total * COMMON_SHARE / 2)) - 1
            values = np.unique(flat[:-step][flat[step:] == flat[:-step]])
            counts = np.searchsorted(flat, values, "right") - np.searchsorted(flat, values, "left")
            totals = np.zeros(len(values) + 1, np.int64)
            totals[-1] = total
            columns = np.append(values.view(np.int64), 0), np.append(counts, 0), totals
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "n", "total"])

        for batch in slices(batches, "text"):
            flat, _ = shingle_sets(batch.column("text"), size)
            waiting.append(flat)
            total += len(flat)
            if total > 4_000_000:
                yield report()
                total = 0
        if total:
            yield report()

    counted = docs.select("text").mapInArrow(run, "shingle long, n long, total long")
    sums = stages.put(counted.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = sums.agg(F.sum("total")).first()[0] or 0
    least = max(COMMON_LEAST, total * COMMON_SHARE / 2)
    rows = sums.where(F.col("n") >= least).select("shingle").toPandas()
    stages.drop(sums)
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def sketches(docs: DataFrame, size: int, similarity: tuple[int, int], common: np.ndarray) -> DataFrame:
    """Per document: set size, 128-bit fingerprint of the set, bin counts, and the window of pivots in order."""
    num, den = similarity
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        common = shared.value
        for batch in slices(batches, "text"):
            flat, counts = shingle_sets(batch.column("text"), size)
            n_docs = len(counts)
            owner = np.repeat(np.arange(n_docs), counts)
            bins = np.zeros((n_docs, BINS), np.int64)
            np.add.at(bins, (owner, (flat >> np.uint64(57)).astype(np.int64)), 1)
            fp1, fp2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
            np.add.at(fp1, owner, mix(flat ^ np.uint64(0x5851F42D4C957F2D)))
            np.add.at(fp2, owner, mix(flat ^ np.uint64(0x14057B7EF767814F)))
            # The order of pivots: a second mixing, with common shingles behind all others.
            order = mix(flat + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(1)
            if len(common):
                at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                order[common[at] == flat] |= np.uint64(1 << 63)
            need = np.where(counts > 0, counts - (num * counts + den - 1) // den + 1, 0)
            parts, base = [], 0
            for d in range(n_docs):
                own = order[base : base + counts[d]]
                base += counts[d]
                k = need[d]
                parts.append(np.sort(np.partition(own, k - 1)[:k] if 0 < k < len(own) else own))
            pivots = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            packed = np.minimum(bins, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("th"),
                    pa.array(counts),
                    pa.array(fp1.view(np.int64)),
                    pa.array(fp2.view(np.int64)),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                    lists(pivots.view(np.int64), need, pa.int64()),
                ],
                ["id", "th", "n", "fp1", "fp2", "bins", "pivots"],
            )

    schema = "id long, th long, n long, fp1 long, fp2 long, bins binary, pivots array<long>"
    return docs.mapInArrow(run, schema)


def unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BINS).astype(np.int32)


def within(l1: np.ndarray, sizes: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """May sets with this L1 distance of bin counts and this sum of sizes be similar enough?"""
    num, den = similarity
    return l1 * (den + num) <= (den - num) * sizes


def thinned(y: np.ndarray, most: int) -> np.ndarray:
    """Mask of the first and the last ``most`` places of every value of ``y``."""
    order = np.argsort(y, kind="stable")
    own = y[order]
    at, first = np.arange(len(y)), np.searchsorted(own, own, "left")
    keep = np.zeros(len(y), bool)
    keep[order] = (at - first < most) | (np.searchsorted(own, own, "right") - at <= most)
    return keep


def region_pairs(
    bins, n, group, similarity, left, right=None, leaf: int = 64, most: int | None = None, cut: list | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different groups that may be linked: within ``left``, or of left and right.

    With ``most``, of a member's partners in a block only so many from either end; blocks of which
    some were held back add to ``cut``.

    Regions larger than ``leaf`` are split around pivots chosen far from each other. A member goes
    to the region of its nearest pivot, and also to the window of another region if its distance
    there exceeds that to its own pivot by no more than twice the largest link distance.
    """
    num, den = similarity

    def brute(a, b, same):
        found = []
        for i in range(0, len(a), 256):
            for j in range(i if same else 0, len(b), 256):
                x, y = a[i : i + 256], b[j : j + 256]
                if (group[x] == group[x[0]]).all() and (group[y] == group[x[0]]).all():
                    continue
                l1 = np.abs(bins[x][:, None, :] - bins[y][None, :, :]).sum(-1)
                ok = within(l1, n[x][:, None] + n[y][None, :], similarity) & (group[x][:, None] != group[y][None, :])
                if same and i == j:
                    ok &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
                p, q = np.nonzero(ok)
                if most is not None and len(q):
                    keep = thinned(q, most)
                    if not keep.all():
                        cut.append(len(q))
                        p, q = p[keep], q[keep]
                found.append((x[p], y[q]))
        return found

    same = right is None
    everyone = left if same else np.concatenate([left, right])
    if len(everyone) <= leaf or (not same and min(len(left), len(right)) <= 8):
        return brute(left, left if same else right, same)
    reach = 2 * (den - num) * 2 * int(n[everyone].max()) / (den + num)
    pivots = [everyone[0]]
    nearest = np.abs(bins[everyone] - bins[pivots[0]]).sum(-1)
    table = [nearest]
    while len(pivots) < 8 and nearest.max() > 0:
        pivots.append(everyone[int(nearest.argmax())])
        table.append(np.abs(bins[everyone] - bins[pivots[-1]]).sum(-1))
        nearest = np.minimum(nearest, table[-1])
    distance = np.stack(table, 1)
    home = distance.argmin(1)
    inside = distance <= distance.min(1)[:, None] + reach
    is_left = np.arange(len(everyone)) < len(left)
    if inside.all() or np.bincount(home).max() > 0.9 * len(everyone):
        return brute(left, left if same else right, same)
    found = []

    def descend(a, b=None):
        size = len(a) + (len(b) if b is not None else 0)
        if not len(a) or b is not None and not len(b):
            return []
        if size > 0.9 * len(everyone):
            return brute(a, a if b is None else b, b is None)
        return region_pairs(bins, n, group, similarity, a, b, leaf, most, cut)

    for j in range(len(pivots)):
        core, guests = home == j, inside[:, j] & (home > j)
        if same:
            found += descend(everyone[core])
            found += descend(everyone[core], everyone[guests])
        else:
            for a, b in ((core, core), (core, guests), (guests, core)):
                found += descend(everyone[a & is_left], everyone[b & ~is_left])
    return found


def _may_link(x, y, label, n, at, prev, similarity: tuple[int, int]) -> np.ndarray:
    """May two members of a cell be linked, of different labels, and have met in no cell before?

    ``at`` is the place of the cell's pivot in the member's order of shingles, ``prev`` the pivot before
    it. Where a pair meets first, none of the shingles ahead of that place are shared.
    """
    num, den = similarity
    room = np.minimum(n[x] - at[x], n[y] - at[y])
    new = (prev[x] != prev[y]) | (at[x] == 0) | (at[y] == 0)
    return (label[x] != label[y]) & new & (room * (num + den) >= num * (n[x] + n[y]))


def _window_steps(cell, label, n, at, prev, similarity: tuple[int, int]):
    """Index pairs ``x < y`` that may link in whole cells, whose members are in order of size.

    Every member meets those after it in its cell, at distance 1, 2, ..., until one is too large.
    """
    num, den = similarity
    i, step = np.arange(len(cell)), 1
    while len(i):
        i = i[i < len(cell) - step]
        i = i[(cell[i] == cell[i + step]) & (n[i] * den >= n[i + step] * num)]
        x = i[_may_link(i, i + step, label, n, at, prev, similarity)]
        yield x, x + step
        step += 1


def _band(similarity: tuple[int, int]):
    """Geometric size bands: linked sizes lie in the same or in neighbouring ones."""
    num, den = similarity
    return F.floor(F.log("n") / F.lit(math.log(den / num) if num < den else 1.0) + 1e-9)


def _pairs_batch(a, b, cells) -> pa.RecordBatch:
    """Distinct pairs ``(a, b, null)``, and ``(null, null, cell)`` for cells with partners held back."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    cells = np.unique(cells)
    none, gap = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(cells), pa.int64())
    columns = [(pa.array(pairs[:, 0]), gap), (pa.array(pairs[:, 1]), gap), (none, pa.array(cells, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "cell"])


def _windowed(cell, node, label, n, at, prev, bins, similarity: tuple[int, int], most: int | None) -> pa.RecordBatch:
    """Pairs of different labels in whole cells, whose members are in order of size."""
    found = [(cell[:0].astype(np.int64),) * 2]
    for p, q in _window_steps(cell, label, n, at, prev, similarity):
        for start in range(0, len(p), 8192):
            x, y = p[start : start + 8192], q[start : start + 8192]
            x_, y_ = bins[x].astype(np.int16), bins[y].astype(np.int16)
            ok = within(np.abs(x_ - y_).sum(-1, dtype=np.int64), n[x] + n[y], similarity)
            found.append((x[ok], y[ok]))
    # Of a member, the farthest partner comes last here, the next one in size first.
    x, y = (np.concatenate(side) for side in zip(*found))
    keep = thinned(y, most) if most is not None else np.ones(len(y), bool)
    return _pairs_batch(node[x[keep]], node[y[keep]], cell[y[~keep]])


def _whole_cells(batches, joined):
    """``joined`` of batches that end where a cell ends; the last cell of a batch waits for the next one."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
        if last or waiting and waiting[-1].column("cell")[-1].as_py() != cell[0]:
            waiting.append(batch.slice(0, last))
            yield joined(pa.Table.from_batches(waiting).combine_chunks())
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield joined(pa.Table.from_batches(waiting).combine_chunks())


def _cell_pairs(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All pairs ``(a, b)`` of different labels in cells of at most ``SMALL_CELL`` members, by size windows."""
    unknown = members.withColumn("at", F.lit(0)).withColumn("prev", F.lit(0).cast("long"))
    return _cell_partners(unknown, similarity, None).select("a", "b")


def _cell_partners(members: DataFrame, similarity: tuple[int, int], most: int | None) -> DataFrame:
    """Pairs ``(a, b, null)`` of different labels in cells of at most ``SMALL_CELL`` members, by size windows.

    With ``most``, of a member's partners only so many from either end, and ``(null, null, cell)`` for
    every cell of which some were held back.
    """

    def joined(table: pa.Table) -> pa.RecordBatch:
        columns = (table.column(c).to_numpy() for c in ("cell", "node", "label", "n", "at", "prev"))
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
        return _windowed(*columns, bins, similarity, most)

    ordered = (
        members.select("cell", "node", "label", "n", "at", "prev", "bins")
        .repartition("cell")
        .sortWithinPartitions("cell", "n")
    )
    return ordered.mapInArrow(lambda batches: _whole_cells(batches, joined), "a long, b long, cell long")


def _cells(classes: DataFrame) -> DataFrame:
    """``(cell, node, label, n, at, prev)``: every pivot of a window, its place, and the pivot before it."""
    before = F.concat(F.array(F.lit(0).cast("long")), "pivots")
    windows = classes.withColumn("before", before).select(
        "node", "n", F.posexplode(F.arrays_zip("pivots", "before")).alias("at", "place")
    )
    return windows.select(
        F.col("place.pivots").alias("cell"), "node", F.col("node").alias("label"), "n", "at", F.col("place.before").alias("prev")
    ).where("cell IS NOT NULL")


def _partnered(cells: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The members that may link with another one of their cell, and whether the cell is ``crowded``.

    Cells of more than ``SMALL_CELL`` members are crowded and keep them all; they pass by without
    being held whole.
    """
    small = SMALL_CELL

    def run(batches):
        waiting, crowd = None, None

        def kept(batch):
            columns = [batch.column(c).to_numpy() for c in ("cell", "label", "n", "at", "prev")]
            cell = columns[0]
            border = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sizes = np.diff(np.append(border, len(cell)))
            crowded = np.repeat(sizes > small, sizes) | (crowd is not None and cell == crowd)
            keep = crowded.copy()
            few = np.flatnonzero(~crowded)
            for x, y in _window_steps(*(c[few] for c in columns), similarity):
                keep[few[x]] = keep[few[y]] = True
            columns = [*batch.columns, pa.array(crowded)]
            return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "crowded"]).filter(pa.array(keep))

        for batch in batches:
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0] if batch.num_rows else waiting
                waiting = None
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            last = len(cell) - int((cell == cell[-1]).sum())
            if len(cell) - last > small or cell[-1] == crowd:
                yield kept(batch)
                crowd = cell[-1]
                continue
            waiting = batch.slice(last)
            if last:
                yield kept(batch.slice(0, last))
        if waiting is not None:
            yield kept(waiting)

    ordered = (
        cells.select("cell", "node", "label", "n", "at", "prev").repartition("cell").sortWithinPartitions("cell", "n")
    )
    schema = "cell long, node long, label long, n long, at int, prev long, crowded boolean"
    return ordered.mapInArrow(run, schema)


def wide_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles per bin, in a power of two of bins that grows with the set: ``BINS`` at least."""
    bits = max(int(BINS).bit_length() - 1, math.ceil(math.log2(max(len(shingles), 1) / BIN_LOAD)))
    bins = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(bins, minlength=1 << bits), 255).astype(np.uint8)


def wide_distance(x: np.ndarray, y: np.ndarray) -> int:
    """L1 distance of two sketches in the bins of the smaller one; never above the symmetric difference."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.abs(y.reshape(len(x), -1).sum(1, dtype=np.int64) - x).sum())


def _wide_unlike(similarity: tuple[int, int]):
    """Drops pairs that wide sketches exclude; a pair without both of them stays."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("wa").to_pylist(), batch.column("wb").to_pylist()
            l1 = [
                0 if x is None or y is None else wide_distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
                for x, y in zip(left, right)
            ]
            sizes = batch.column("na").fill_null(0).to_numpy() + batch.column("nb").fill_null(0).to_numpy()
            ok = within(np.array(l1, np.int64), sizes, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _perhaps_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents in ``wanted(id, th)`` and a few more: what a bit per hash lets pass.

    The filter has ``FILTER_BITS`` bits, in at most a 64th as many rows, so it can go to every task;
    only texts that pass it are shuffled.
    """
    place = F.pmod(F.xxhash64("id", "th"), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("place")).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place % 64 AS int))").alias("bit")
    )
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    spread = docs.withColumn("place", place).withColumn("word", F.shiftright("place", 6))
    passed = spread.join(F.broadcast(words), "word").where("getbit(bits, cast(place % 64 AS int)) = 1")
    return passed.select(*docs.columns)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity, stages: Stages) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    num, den = similarity
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stages.put(classes.join(nodes, "node").select("node", "n", "id", "th"))

    def run(batches):
        for batch in slices(batches, "text"):
            flat, counts = shingle_sets(batch.column("text"), size)
            ends = np.cumsum(counts)
            wide = [wide_counts(flat[e - c : e]).tobytes() for c, e in zip(counts, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("n"),
                    pa.array(wide, pa.binary()),
                    lists(flat.view(np.int64), counts, pa.int64()),
                ],
                ["node", "n", "wide", "shingles"],
            )

    texts = _perhaps_in(docs, wanted).join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("node", "n", "text")
    schema = "node long, n long, wide binary, shingles array<long>"
    sets = stages.put(texts.mapInArrow(run, schema))
    # A pair carries whole sets through the second join, so wide sketches, some 32 times smaller, go first.
    # Sets with no more bins than the first comparison had need none.
    wide = sets.where(F.length("wide") > BINS).select("node", "n", "wide")
    alike = pairs.join(wide.toDF("a", "na", "wa"), "a", "left").join(wide.toDF("b", "nb", "wb"), "b", "left")
    alike = stages.put(alike.mapInArrow(_wide_unlike(similarity), "a long, b long"))
    left_over = alike.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = sets.select("node", "shingles").join(left_over, "node", "left_semi")
    inter = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - inter
    links = []
    for part in range(VERIFY_PARTS):
        some = alike.where(F.pmod(F.xxhash64("a"), F.lit(VERIFY_PARTS)) == part)
        left = whole.where(F.pmod(F.xxhash64("node"), F.lit(VERIFY_PARTS)) == part)
        linked = (
            some.join(left.toDF("a", "sa"), "a")
            .join(whole.toDF("b", "sb"), "b")
            .where(den * inter >= num * union)
            .select("a", "b")
        )
        links.append(stages.put(linked))
    stages.drop(wanted, sets, alike)
    return reduce(DataFrame.union, links)


def _blocks(members: DataFrame, similarity: tuple[int, int], region: int) -> DataFrame:
    """Members of mixed cells by size band and, in crowded bands, by pairs of blocks.

    Bands are geometric with the ratio of the threshold, so linked sizes lie in the same or in
    neighbouring bands: a member is also a guest of the band above its own.
    """
    own = _band(similarity)
    banded = members.withColumn("band", F.explode(F.array(own, own + 1))).withColumn("guest", F.col("band") != own)
    sizes = banded.groupBy("cell", "band").agg(F.ceil(F.count("*") / region).cast("int").alias("k"))
    placed = banded.join(sizes, ["cell", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), "k").cast("int"))
    return (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("cell", "band", "i", "j", "node", "n", "bins", "label", "at", "prev", "guest", "block")
    )


def _set_classes(docs: DataFrame, text: str, doc_id: str, shingle: int, similarity, stages: Stages):
    """The keyed documents, the size and fingerprint of their sets, and one ``node`` per distinct set."""
    docs = keyed(docs, text, doc_id)
    common = common_shingles(docs, shingle, stages)
    rows = stages.put(sketches(docs, shingle, similarity, common))

    classes = (
        rows.where("n > 0")
        .groupBy("fp1", "fp2", "n")
        .agg(F.min(F.struct("id", "th")).alias("row"), F.first("bins").alias("bins"), F.first("pivots").alias("pivots"))
        .select("fp1", "fp2", "n", "row.id", "row.th", "bins", "pivots")
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = stages.put(classes)
    slim = stages.put(rows.select("id", "th", "n", "fp1", "fp2"))
    stages.drop(rows)
    return docs, slim, classes


def _partners(members: DataFrame, classes: DataFrame, similarity, region: int, most: int | None) -> DataFrame:
    """Candidate pairs of different labels in the cells of ``members``, as `_cell_partners` gives them."""
    full = members.join(classes.select("node", "bins"), "node")
    few = _cell_partners(full.where("NOT crowded"), similarity, most)

    def join_region(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell, _, i, j = key
        frame = frame.sort_values("n", kind="stable")
        bins, n = unpack(frame["bins"]), frame["n"].to_numpy()
        group, node = frame["label"].to_numpy(), frame["node"].to_numpy()
        block, guest = frame["block"].to_numpy(), frame["guest"].to_numpy()
        everyone, cut = np.arange(len(frame)), []
        if i == j:
            found = region_pairs(bins, n, group, similarity, everyone, most=most, cut=cut)
        else:
            left, right = everyone[block == i], everyone[block == j]
            found = region_pairs(bins, n, group, similarity, left, right, most=most, cut=cut)
        p = np.concatenate([x for x, _ in found]) if found else everyone[:0]
        q = np.concatenate([y for _, y in found]) if found else everyone[:0]
        keep = ~(guest[p] & guest[q])
        keep &= _may_link(p, q, group, n, frame["at"].to_numpy(), frame["prev"].to_numpy(), similarity)
        p, q = node[p[keep]], node[q[keep]]
        again = np.array([cell] if cut else [], np.int64)
        return _pairs_batch(p, q, again).to_pandas(integer_object_nulls=True).astype("Int64")

    blocks = _blocks(full.where("crowded"), similarity, region).groupBy("cell", "band", "i", "j")
    return few.union(blocks.applyInPandas(join_region, "a long, b long, cell long"))


def linked_classes(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
    region: int = REGION,
) -> DataFrame:
    """``(id, th, n_shingles, component_id)`` per document; ``similarity`` is a fraction of integers.

    ``component_id`` is the smallest id that links reach. Texts without words, null ones included,
    have no shingles and link with nothing: their own id is their component. With fewer words than
    ``shingle`` the whole sequence is the only shingle. Rows with a missing id count as larger than
    all others and have the id `NO_ID`; repeated rows are equal sets and lie in one class. An empty
    table gives an empty result. Other columns are not read.
    """
    stages = Stages(docs.sparkSession)
    docs, rows, classes = _set_classes(docs, text, doc_id, shingle, similarity, stages)
    members = stages.put(_partnered(_cells(classes), similarity))
    links, most = None, FIRST_PARTNERS
    while True:
        found = stages.put(_partners(members, classes, similarity, region, most))
        pairs = stages.put(found.where("cell IS NULL").select("a", "b").distinct())
        more = _verified(pairs, classes, docs, shingle, similarity, stages)
        links = stages.put(links.union(more) if links is not None else more)
        final = linked_labels(links, stages)
        again = found.where("cell IS NOT NULL").select("cell").distinct()
        if again.isEmpty():
            break
        labelled = members.drop("label", "crowded").join(again, "cell", "left_semi").join(final, "node", "left")
        left = stages.put(_partnered(labelled.withColumn("label", F.coalesce("label", "node")), similarity))
        stages.drop(members, found, pairs)
        members, most = left, most * MORE_PARTNERS if most * MORE_PARTNERS < SMALL_CELL else None

    named = classes.select("node", "fp1", "fp2", "n", "id").join(final, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    lowest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = stages.put(named.join(lowest, "label").select("fp1", "fp2", "n", "component_id"))
    return stages.last(
        rows.join(named, ["fp1", "fp2", "n"], "left").select(
            "id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
        )
    )


def linked_pairs(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
    region: int = REGION,
) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and which documents have which set.

    The links are ``(set_a, set_b)`` with ``set_a < set_b``, numbers of distinct sets; the members are
    ``(doc_id, n_shingles, set, n_links)`` per document, ``n_links`` counting the other sets its own is
    linked with. Documents of one set are linked with each other too and not written as pairs. A
    document without words has no set (null) and no links. Missing ids are null, repeated rows are
    members of one set each, an empty table gives two empty results. The number of links of a class of
    k sets may be k (k - 1) / 2: that is the result asked for, where `linked_classes` needs only classes.
    """
    stages = Stages(docs.sparkSession)
    docs, rows, classes = _set_classes(docs, text, doc_id, shingle, similarity, stages)
    members = stages.put(_partnered(_cells(classes), similarity))
    found = stages.put(_partners(members, classes, similarity, region, None).select("a", "b").distinct())
    links = _verified(found, classes, docs, shingle, similarity, stages)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = classes.select("node", "fp1", "fp2", "n").join(degree, "node", "left")
    members = rows.join(named, ["fp1", "fp2", "n"], "left").select(
        public_id("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("node").alias("set"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    pairs = links.select(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b"))
    return stages.last(pairs, members)


def component_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document, ids as given."""
    found = linked_classes(docs, **options)
    return found.select(public_id("id").alias("doc_id"), "n_shingles", public_id("component_id").alias("component_id"))


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of every class the row with the smallest id stays.

    Rows without words all stay; of rows equal in that id and text the smallest by all columns stays.
    All columns are kept, whatever their names.
    """
    found = linked_classes(docs, **options)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th")]
    stay = (
        found.where("n_shingles > 0")
        .groupBy("component_id")
        .agg(F.min(F.struct("id", "th")).alias("row"))
        .select(F.col("row.id").alias("_id"), F.col("row.th").alias("_th"))
    )
    marked = docs.select(packed(docs), *key)
    kept = marked.join(stay, ["_id", "_th"], "left_semi").groupBy("_id", "_th").agg(one_of(docs))
    blank = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("row.*").unionByName(blank)
