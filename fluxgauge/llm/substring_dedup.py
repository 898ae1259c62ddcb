"""Removal of repeated passages by a join of word windows with an index of all documents.

The reference is the whole corpus: a window index, dealt into blocks by hash, knows for every
passage of ``window`` words its first occurrence, that of the smallest id. All windows of a document
that can repeat are looked up by an equi-join, and the words of every window found in a document
with a smaller id are removed. All other words stay.

This replaces greedy relative Lempel-Ziv factoring, which is not done: no factor is extended
against a block, and no window at a border is looked up on its own. Factors of at least ``window``
words against all smaller ids cover the same words as the union of such windows, and the join
needs neither an order of lookups nor a text of the reference beside the document. Hits that follow
each other in one source are grouped into factors afterwards. The source of a window is its smallest
id, so a long copied passage may be several factors; only the removed words are exact.

Most windows occur once, and are never sent to the index. Of the ``gram``-word sequences in a
window the one with the smallest hash is its anchor; equal windows have equal anchors, so only
windows whose anchor occurs in two documents can repeat (about one anchor per five words moves).
Windows are compared by 96-bit fingerprints of their words. The index is built and asked block by
block, so that only one block of it is on its way at a time.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.tables import Stages, keyed, public_id
from fluxgauge.llm.text import Words, buffer, lists, slices, split_words, windows

WINDOW = 13
GRAM = 6
#: Blocks of the window index.
BLOCKS = 4

_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours."""
    out, width = values, 1
    while width * 2 <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = span - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window inside one document: its position, document and anchor."""
    if len(words.hash) < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    lowest = sliding_min(windows(words.hash, gram), window - gram + 1)
    document = words.document()
    at = np.flatnonzero(document[: len(lowest)] == document[window - 1 :])
    return at, document[at], lowest[at]


def _anchor_lists(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text"):
            words = split_words(*buffer(batch.column("text")))
            _, document, lowest = anchors(words, window, gram)
            fresh = np.ones(len(lowest), bool)
            fresh[1:] = (lowest[1:] != lowest[:-1]) | (document[1:] != document[:-1])
            counts = np.bincount(document[fresh], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), lists(lowest[fresh].view(np.int64), counts, pa.int64())],
                ["id", "th", "anchors"],
            )

    return docs.mapInArrow(run, "id long, th long, anchors array<long>")


def _list_slices(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column; null lists are empty."""
    lengths = np.array([len(x) if x is not None else 0 for x in column], np.int64) if column.null_count else np.diff(
        np.asarray(column.offsets)
    )
    return np.concatenate(([0], np.cumsum(lengths))), column.flatten()


def _window_lists(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Positions and fingerprints of the windows whose anchor is in the row's list."""

    def run(batches):
        for batch in slices(batches, "text"):
            words = split_words(*buffer(batch.column("text")))
            at, document, lowest = anchors(words, window, gram)
            border, flat = _list_slices(batch.column("shared"))
            flat = flat.to_numpy(zero_copy_only=False).view(np.uint64)
            edges = np.searchsorted(document, np.arange(batch.num_rows + 1))
            keep = np.zeros(len(at), bool)
            for d in range(batch.num_rows):
                a, b = edges[d], edges[d + 1]
                keep[a:b] = np.isin(lowest[a:b], flat[border[d] : border[d + 1]])
            at, document = at[keep], document[keep]
            counts = np.bincount(document, minlength=batch.num_rows)
            start = (at - words.first[document]).astype(np.int32)
            prints = [windows(words.hash, window, which) for which in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("th"),
                    lists(start, counts, pa.int32()),
                    lists(prints[0][at].view(np.int64), counts, pa.int64()),
                    lists((prints[1][at] >> np.uint64(32)).astype(np.uint32).view(np.int32), counts, pa.int32()),
                ],
                ["id", "th", "start", "f1", "f2"],
            )

    return docs.mapInArrow(run, "id long, th long, start array<int>, f1 array<long>, f2 array<int>")


def _joined_words(data: np.ndarray, words: Words, keep: np.ndarray) -> pa.StringArray:
    """Per document its kept words, joined by one space."""
    start, size = words.start[keep], (words.end - words.start)[keep] + 1
    total = np.concatenate(([0], np.cumsum(size)))
    index = np.repeat(start - total[:-1], size) + np.arange(total[-1])
    out = np.append(data, np.uint8(32))[index]
    out[total[1:] - 1] = 32
    kept = np.concatenate(([0], np.cumsum(keep)))
    ends = total[kept[words.first]]
    # A document with words has a space behind its last one, which goes.
    filled = np.diff(ends) > 0
    out = np.delete(out, ends[1:][filled] - 1)
    offsets = np.concatenate(([0], np.cumsum(np.diff(ends) - filled))).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(out))


def _parsed(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text"):
            data, offsets = buffer(batch.column("text"))
            words = split_words(data, offsets)
            border, hits = _list_slices(batch.column("hits"))
            start, source, source_start = (x.to_numpy(zero_copy_only=False) for x in hits.flatten())
            document = np.repeat(np.arange(batch.num_rows), np.diff(border))
            order = np.lexsort((start, document))
            start, source, source_start, document = (x[order] for x in (start, source, source_start, document))
            # Greedy factors: runs of hits that go on, word by word, in one source.
            fresh = np.ones(len(start), bool)
            fresh[1:] = (
                (document[1:] != document[:-1])
                | (start[1:] != start[:-1] + 1)
                | (source[1:] != source[:-1])
                | (source_start[1:] != source_start[:-1] + 1)
            )
            head = np.flatnonzero(fresh)
            runs = np.diff(np.append(head, len(start)))
            # Words under any factor; factors may overlap by the windows at their borders.
            step = np.zeros(len(words.hash) + 1, np.int64)
            begin = words.first[document[head]] + start[head]
            np.add.at(step, begin, 1)
            np.add.at(step, begin + runs + window - 1, -1)
            keep = np.cumsum(step[:-1]) == 0
            kept = np.concatenate(([0], np.cumsum(keep)))[words.first]
            factors = pa.StructArray.from_arrays(
                [
                    pa.array(start[head], pa.int32()),
                    pa.array(runs + window - 1, pa.int32()),
                    pa.array(source[head], pa.int64()),
                    pa.array(source_start[head], pa.int32()),
                ],
                fields=list(_FACTOR),
            )
            per = np.concatenate(([0], np.cumsum(np.bincount(document[head], minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(words.counts),
                    pa.array(words.counts - np.diff(kept)),
                    _joined_words(data, words, keep),
                    pa.ListArray.from_arrays(pa.array(per), factors),
                ],
                ["id", "n_words", "n_removed", "kept", "factors"],
            )

    return docs.mapInArrow(
        run,
        "id long, n_words long, n_removed long, kept string, "
        "factors array<struct<start: int, length: int, source: long, source_start: int>>",
    )


def without_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, factors)`` per document.

    ``kept`` joins the words outside all factors by one space; a factor names its first word, its
    length, and the document and word where the same words stand. Windows are those of the input.
    Null and empty texts have no words. A missing id counts as larger than all others; rows with
    equal ids never serve as each other's source. An empty table gives an empty result; other
    columns are not read.
    """
    stages = Stages(docs.sparkSession)
    docs = keyed(docs, text, doc_id)
    listed = stages.put(_anchor_lists(docs, window, gram))
    flat = listed.select("id", "th", F.explode("anchors").alias("anchor"))
    shared = flat.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    # Per id and text, not per id: rows without an id are many texts.
    own = flat.join(shared.select("anchor"), "anchor").groupBy("id", "th").agg(F.collect_set("anchor").alias("shared"))
    own = stages.put(own)
    stages.drop(listed)

    found = stages.put(_window_lists(docs.join(own, ["id", "th"]), window, gram))
    stages.drop(own)
    each = found.select("id", "th", F.explode(F.arrays_zip("start", "f1", "f2")).alias("w")).select("id", "th", "w.*")
    parts = []
    for block in range(BLOCKS):
        here = each.where(F.pmod("f1", F.lit(BLOCKS)) == block)
        first = (
            here.groupBy("f1", "f2")
            .agg(F.min(F.struct("id", "start")).alias("source"), F.max("id").alias("high"))
            .where("source.id < high")
            .select("f1", "f2", "source")
        )
        # Stored, so that its size is known and a crowded window is split on the other side.
        first = stages.put(first)
        later = here.join(first, ["f1", "f2"]).where("source.id < id")
        source = F.col("source.id").alias("source"), F.col("source.start").alias("source_start")
        parts.append(stages.put(later.select("id", "th", "start", *source)))
        stages.drop(first)
    stages.drop(found)
    hits = functools.reduce(DataFrame.union, parts)
    # A set: rows that repeat an id and a text bring the same hits.
    hits = hits.groupBy("id", "th").agg(F.collect_set(F.struct("start", "source", "source_start")).alias("hits"))
    hits = stages.put(hits)
    stages.drop(*parts)
    empty = F.expr("cast(array() as array<struct<start: int, source: bigint, source_start: int>>)")
    parsed = _parsed(docs.join(hits, ["id", "th"], "left").withColumn("hits", F.coalesce("hits", empty)), window)
    return parsed.select(public_id("id").alias("doc_id"), "n_words", "n_removed", "kept", "factors")
