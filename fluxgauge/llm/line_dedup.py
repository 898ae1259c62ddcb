"""Lines that an earlier document holds, found in a sharded minimal perfect hash of all lines.

1. Every document gives a 128-bit hash per line that counts; holders are counted per hash and the
   smallest one is kept, combined before the shuffle.
2. Hashes are dealt to shards of some 16,000. A shard is one row: a minimal perfect hash of its
   keys, and arrays by key number: a fingerprint of 32 bits, the number of holders in as few bytes
   as the largest needs, and the first holder.
3. Documents send the hashes of their lines (never the lines) to the shards and look them up in
   the arrays. A shard that much is asked of is copied, and its askers are dealt over the copies.
4. What was found goes back to the documents, which drop these lines.

All keys of the documents themselves are in the index, so every look-up meets its own entry; the
fingerprint turns away lines of other documents, if an index is asked for those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.perfect_hash import PerfectHash
from fluxgauge.llm.tables import Stages, keyed, public_id
from fluxgauge.llm.text import LOWER, SEGMENT, SPACE, buffer, mix, powers, slices

SHARD_KEYS = 1 << 14
#: Look-ups that one task makes in one copy of a shard.
SHARD_LOADS = 1 << 16

_BASES = (0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(12).integers(1, 2**64, (2, 256), dtype=np.uint64)


class Lines:
    """Lines of some texts: byte spans ``start:end``, ``first[d]`` the first line of text d, and
    per line the 128-bit hash ``one, two`` of its key and the key's length in code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        # A text has a line more than line ends: its last line ends where the text does.
        doc = np.searchsorted(offsets, breaks, side="right") - 1
        order = np.argsort(np.concatenate([doc, np.arange(len(offsets) - 1)]), kind="stable")
        self.end = np.concatenate([breaks, offsets[1:]])[order]
        counts = np.bincount(doc, minlength=len(offsets) - 1) + 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.start = np.empty_like(self.end)
        self.start[1:] = self.end[:-1] + 1
        self.start[self.first[:-1]] = offsets[:-1]
        self.one = np.zeros(len(self.end), np.uint64)
        self.two = np.zeros(len(self.end), np.uint64)
        self.length = np.zeros(len(self.end), np.int64)
        at = 0
        while at < len(self.end):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + SEGMENT, side="right")))
            self._hash(data, slice(at, to))
            at = to

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _hash(self, data: np.ndarray, lines: slice) -> None:
        a, b = int(self.start[lines][0]), int(self.end[lines][-1])
        part = data[a:b]
        start, end = self.start[lines] - a, self.end[lines] - a
        solid = np.flatnonzero(~SPACE[part])
        left = np.searchsorted(solid, start)
        right = np.searchsorted(solid, end)
        some = right > left
        key_start, key_end = np.zeros_like(start), np.zeros_like(end)
        key_start[some], key_end[some] = solid[left[some]], solid[right[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        self.length[lines] = points[key_end] - points[key_start]
        letters = LOWER[part]
        for out, base, table in ((self.one, _BASES[0], _BYTES[0]), (self.two, _BASES[1], _BYTES[1])):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[letters] * powers(base, 1, len(part)), out=total[1:])
            h = (total[key_end] - total[key_start]) * powers(base, -1, len(part) + 1)[key_start]
            out[lines] = mix(h + mix((key_end - key_start).astype(np.uint64)))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def line_keys(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(id, th, one, two, turn)`` per row of ``keyed`` documents and distinct key of ``least`` code
    points or more. ``turn`` spreads equal rows evenly, whatever they are."""

    def found(batches) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in slices(batches, "text"):
            lines = Lines(*buffer(batch.column("text")))
            row = np.repeat(np.arange(batch.num_rows), lines.counts)
            keep = np.flatnonzero(lines.length >= least)
            order = keep[np.lexsort((lines.two[keep], lines.one[keep], row[keep]))]
            same = (
                (row[order][1:] == row[order][:-1])
                & (lines.one[order][1:] == lines.one[order][:-1])
                & (lines.two[order][1:] == lines.two[order][:-1])
            )
            order = order[np.concatenate([[True], ~same])] if len(order) else order
            turn = mix(np.arange(seen, seen + len(order), dtype=np.uint64))
            seen += len(order)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row[order])),
                    batch.column("th").take(pa.array(row[order])),
                    _signed(lines.one[order]),
                    _signed(lines.two[order]),
                    _signed(turn),
                ],
                ["id", "th", "one", "two", "turn"],
            )

    return docs.mapInArrow(found, "id long, th long, one long, two long, turn long")


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("two", 32), F.lit(shards))


def holders(keys: DataFrame) -> DataFrame:
    """``(one, two, holders, first)``: number of rows that hold a key, and the smallest id among them."""
    return keys.groupBy("one", "two").agg(F.count("*").alias("holders"), F.min("id").alias("first"))


def sharded(held: DataFrame, shards: int) -> DataFrame:
    """``(shard, sizes, bits, prints, counts, firsts)``: one row per shard that has keys."""

    def build(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("one", "two", "holders", "first")}
        one, two = columns["one"].view(np.uint64), columns["two"].view(np.uint64)
        function = PerfectHash.build(one, two)
        number = function.numbers(one, two)
        n = len(number)
        narrow = np.min_scalar_type(int(columns["holders"].max()))
        arrays = np.zeros(n, np.uint32), np.zeros(n, narrow), np.zeros(n, np.int64)
        for out, values in zip(arrays, (two, columns["holders"], columns["first"])):
            out[number] = values.astype(out.dtype)
        row = [function.sizes, function.bits, *arrays]
        return pa.table(
            {"shard": table.column("shard")[:1]}
            | {c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("sizes", "bits", "prints", "counts", "firsts"), row)}
        )

    schema = "shard long, sizes binary, bits binary, prints binary, counts binary, firsts binary"
    return held.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, schema)


class Shard:
    """A shard's arrays, as stored by ``sharded``."""

    def __init__(self, row: dict):
        self.function = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8))
        self.prints = np.frombuffer(row["prints"], np.uint32)
        self.firsts = np.frombuffer(row["firsts"], np.int64)
        self.counts = np.frombuffer(row["counts"], f"u{len(row['counts']) // len(self.prints)}")

    def look_up(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Holders and first holder per key; no holders for keys the fingerprints do not know."""
        number = self.function.numbers(one, two)
        known = (number >= 0) & (self.prints[number] == two.astype(np.uint32))
        return np.where(known, self.counts[number].astype(np.int64), 0), self.firsts[number]


def probed(keys: DataFrame, index: DataFrame, loads: DataFrame, shards: int, least_holders: int) -> DataFrame:
    """``(id, th, one)`` of the keys that ``least_holders`` rows hold and a smaller id holds first.

    ``loads(shard, copies)`` names the shards that take more than one task, which are at most as
    many as there are keys / ``SHARD_LOADS``.
    """
    many = F.broadcast(loads)
    asked = (
        keys.withColumn("shard", _shard(shards))
        .join(many, "shard", "left")
        .withColumn("copy", F.pmod("turn", F.coalesce("copies", F.lit(1))))
        .select("shard", "copy", "id", "th", "one", "two")
    )
    copied = index.join(many, "shard", "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))
    )

    def look_up(asked: pa.Table, shard: pa.Table) -> pa.Table:
        out = asked.select(["id", "th", "one"])
        if not asked.num_rows or not shard.num_rows:
            return out.slice(0, 0)
        one, two = (asked.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
        held, first = Shard(shard.slice(0, 1).to_pylist()[0]).look_up(one, two)
        return out.filter(pa.array((held >= least_holders) & (first < asked.column("id").to_numpy())))

    sides = asked.groupBy("shard", "copy"), copied.drop("copies").groupBy("shard", "copy")
    return sides[0].cogroup(sides[1]).applyInArrow(look_up, "id long, th long, one long")


def _cut(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose hash is among the row's ``gone``."""
    for batch in slices(batches, "text"):
        data, offsets = buffer(batch.column("text"))
        lines = Lines(data, offsets)
        gone, counts = batch.column("gone"), lines.counts
        kept, dropped = [], np.zeros(batch.num_rows, np.int64)
        for d in range(batch.num_rows):
            a, b = lines.first[d], lines.first[d + 1]
            if not gone[d].is_valid:
                kept.append(data[offsets[d] : offsets[d + 1]].tobytes())
                continue
            hashes = gone[d].values.to_numpy(zero_copy_only=False).view(np.uint64)
            stay = ~(np.isin(lines.one[a:b], hashes) & (lines.length[a:b] >= least))
            dropped[d] = (b - a) - stay.sum()
            spans = zip(lines.start[a:b][stay].tolist(), lines.end[a:b][stay].tolist())
            kept.append(b"\n".join(data[s:e].tobytes() for s, e in spans))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(counts, pa.int64()),
                pa.array(dropped, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["row", "n_lines", "n_dropped", "kept"],
        )


def without_repeated_lines(
    docs: DataFrame, least: int = 10, least_holders: int = 2, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` per row of ``docs``.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Lines whose
    key has ``least`` code points and is held by ``least_holders`` rows are dropped, except in rows
    with the smallest id that holds it, where all of them stay. A null or empty text is one empty
    line. A missing id counts as the largest; rows that share an id keep a line together. Texts of
    any length are worked on a line at a time where they exceed a segment. An empty table gives an
    empty result. Other columns are not read.
    """
    stages = Stages(docs.sparkSession)
    rows = keyed(docs, text, doc_id)
    keys = stages.put(line_keys(rows, least))
    held = stages.put(holders(keys))
    shards = max(1, -(-held.count() // SHARD_KEYS))
    index = stages.put(sharded(held, shards))
    loads = held.groupBy(_shard(shards).alias("shard")).agg(F.sum("holders").alias("load"))
    loads = stages.put(
        loads.where(F.col("load") > SHARD_LOADS).select("shard", F.ceil(F.col("load") / SHARD_LOADS).alias("copies"))
    )
    hits = stages.put(probed(keys, index, loads, shards, least_holders))
    stages.drop(keys, held, index, loads)
    gone = hits.groupBy("id", "th").agg(F.collect_set("one").alias("gone"))
    told = rows.join(gone, ["id", "th"], "left").select(F.col("id").alias("row"), "text", "gone")
    cut = told.mapInArrow(lambda batches: _cut(batches, least), "row long, n_lines long, n_dropped long, kept string")
    return cut.select(public_id("row").alias("doc_id"), "n_lines", "n_dropped", "kept")
