"""Product codes of vectors with memoised grid cells.

Vectors become integers, floor(256 x), and are cut into parts; each part is coded by the nearest
entry of its codebook. The nearest entry is searched only among those that can win: space is cut
into coarse cells, and for each cell met a task remembers the entries that no other entry beats
across the whole cell (an entry whose least distance to the box exceeds another's greatest is
dominated). Vectors of a cell evaluate just these, exactly. A memo is a speed-up only: it is
emptied when full, and results never depend on it.

Fitting is a sum and a count per entry: tasks add up their vectors, Spark adds up the tasks, and
only the codebooks (entries x dimension numbers) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.tables import NO_ID, Stages, public_id
from fluxgauge.llm.text import mix

SCALE = 256
#: Integers beyond this are taken as this: distances then still fit into 128 bits.
FARTHEST = 2**62
#: Errors saturate here, the largest long.
WORST = 2**63 - 1
#: Cells a task remembers per part.
MEMO = 1 << 15
_ROWS = 2048


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """``(id, vec, label)`` of the vectors that exist and hold finite numbers only; missing ids last."""
    numbers = F.col(vector).cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), numbers.alias("vec"), F.col(label).alias("label")
    )


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of every vector as rows of ``dim`` numbers; shorter vectors end in zeros."""
    counts = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), counts)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -float(FARTHEST), float(FARTHEST)).astype(np.int64)


def _exact(low: int, high: int, width: int) -> type:
    """The number type that holds ``width`` squared differences of numbers of that range, summed."""
    return np.int64 if width * (high - low) ** 2 < 2**62 else object


def _squares(a: np.ndarray, kind: type) -> np.ndarray:
    a = a.astype(kind)
    return (a * a).sum(axis=-1) if a.shape[-1] else np.zeros(a.shape[:-1], kind)


def cell_side(book: np.ndarray) -> int:
    """Side of the cells, as a power of two: about twice the usual gap between neighbouring entries, per
    axis. Finer cells have fewer candidates each, but most vectors then come to a cell of their own."""
    if len(book) < 2 or not book.shape[1]:
        return 1
    points = book.astype(float)
    gaps = ((points[:, None] - points[None]) ** 2).sum(axis=-1)
    np.fill_diagonal(gaps, np.inf)
    usual = np.sqrt(np.median(gaps.min(axis=1)) / book.shape[1])
    return 1 << max(0, int(np.log2(max(usual * 2, 1.0))))


class CellMemo:
    """Nearest entries of one codebook, with the undominated entries of every cell met so far."""

    def __init__(self, book: np.ndarray, capacity: int = MEMO):
        self.book, self.capacity = book, capacity
        self.shift = cell_side(book).bit_length() - 1
        self.cells: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def candidates(self, corner: np.ndarray, kind: type) -> list[np.ndarray]:
        """Per cell (its smallest point) the entries that may be nearest to some point of it."""
        low = corner.astype(kind)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        book = self.book.astype(kind)[None]
        nearest = _squares(np.maximum(np.maximum(low - book, book - high), 0), kind)
        farthest = _squares(np.maximum(abs(book - low), abs(high - book)), kind)
        may_win = nearest <= farthest.min(axis=1, keepdims=True)
        entry = np.nonzero(may_win)[1]
        return np.split(entry, np.cumsum(may_win.sum(axis=1))[:-1])

    def _cells_of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of every distinct cell, and the cell of every row: by hash, by value if two hashes meet."""
        h = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            h = mix(h + column.astype(np.uint64))
        _, first, cell = np.unique(h, return_index=True, return_inverse=True)
        if not np.array_equal(cells[first][cell], cells):
            _, first, cell = np.unique(cells, axis=0, return_index=True, return_inverse=True)
        return first, cell.reshape(-1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row (ties: the lower) and its squared distance."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        low = int(min(x.min(), self.book.min())) - (1 << self.shift)
        kind = _exact(low, int(max(x.max(), self.book.max())) + (1 << self.shift), x.shape[1])
        cells = x >> self.shift
        first, cell = self._cells_of(cells)
        keys = [cells[at].tobytes() for at in first]
        if len(self.cells) > self.capacity:
            self.cells.clear()
        new = [k for k, key in enumerate(keys) if key not in self.cells]
        for at in range(0, len(new), 256):
            block = new[at : at + 256]
            found = self.candidates(cells[first[block]] << self.shift, kind)
            self.cells |= {keys[k]: entries for k, entries in zip(block, found)}
        lists = [self.cells[key] for key in keys]
        counts = np.array([len(entries) for entries in lists])
        starts = np.cumsum(counts) - counts
        flat = np.concatenate(lists)
        # One line per (row, candidate); the rows of a cell share its list.
        n = counts[cell]
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(len(x)), n)
        entry = flat[np.arange(len(row)) - np.repeat(begin - starts[cell], n)]
        self.evaluated += len(row)
        distance = _squares(x[row].astype(kind) - self.book[entry].astype(kind), kind)
        best = np.minimum.reduceat(distance, begin)
        winner = np.where(distance == best[row], entry, len(self.book))
        return np.minimum.reduceat(winner, begin), best


@dataclass(frozen=True)
class Codebooks:
    """``books[p]``: entries x width integers of part p."""

    books: tuple[np.ndarray, ...]

    @property
    def dim(self) -> int:
        return sum(book.shape[1] for book in self.books)

    def sha256(self) -> str:
        """Digest of all integers by part, entry and position, joined by commas."""
        flat = ",".join(str(int(x)) for book in self.books for x in book.reshape(-1))
        return hashlib.sha256(flat.encode()).hexdigest()

    def memos(self) -> list[CellMemo]:
        return [CellMemo(book) for book in self.books]

    def blocks(self, batches, memos: list[CellMemo]) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Rows in blocks with ``(integers, entry, distance)`` per part."""
        width = self.dim // len(self.books)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                numbers = integers(part.column("vec"), self.dim)
                xs = [np.ascontiguousarray(numbers[:, p * width : (p + 1) * width]) for p in range(len(self.books))]
                yield part, [(x, *memo.nearest(x)) for x, memo in zip(xs, memos)]


def _first_books(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """Parts of the vectors with the smallest ids; a vector's numbers decide between equal ids."""
    longest = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    width = -(-longest // parts)
    rows = vectors.select("id", "vec").orderBy("id", "vec").limit(entries).collect()
    whole = integers(pa.array([r["vec"] for r in rows], pa.list_(pa.float64())), width * parts)
    return Codebooks(tuple(whole[:, p * width : (p + 1) * width] for p in range(parts)))


def _refitted(vectors: DataFrame, old: Codebooks) -> Codebooks:
    """Entries replaced by the floored mean of the parts assigned to them; unused ones stay."""

    def summed(batches):
        total = [np.zeros(book.shape, object) for book in old.books]
        count = [np.zeros(len(book), np.int64) for book in old.books]
        for _, found in old.blocks(batches, old.memos()):
            for p, (x, entry, _) in enumerate(found):
                # Halves of the numbers, as their sum over a block must fit.
                for part, weight in ((x >> 31, 2**31), (x & (2**31 - 1), 1)):
                    sums = np.zeros(old.books[p].shape, np.int64)
                    np.add.at(sums, entry, part)
                    total[p] += sums.astype(object) * weight
                count[p] += np.bincount(entry, minlength=len(count[p]))
        for p, (sums, n) in enumerate(zip(total, count)):
            used = np.flatnonzero(n)
            width = sums.shape[1]
            if len(used) and width:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used) * width, p), pa.int32()),
                        pa.array(np.repeat(used, width), pa.int32()),
                        pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                        pa.array([Decimal(int(v)) for v in sums[used].reshape(-1)], pa.decimal128(38, 0)),
                        pa.array(np.repeat(n[used], width), pa.int64()),
                    ],
                    ["part", "entry", "at", "total", "n"],
                )

    partial = vectors.select("vec").mapInArrow(summed, "part int, entry int, at int, total decimal(38,0), n long")
    new = [book.copy() for book in old.books]
    for r in partial.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return Codebooks(tuple(new))


def fitted(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks of ``usable`` vectors: parts of the first vectors, then means, ``rounds`` times."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    books = _first_books(vectors, parts, entries)
    for _ in range(rounds):
        books = _refitted(vectors, books)
    return books


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``(id, label, code, error)`` of ``usable`` vectors; a label is handed on as it is."""
    label = vectors.schema["label"].dataType.simpleString()

    def coded(batches):
        for rows, found in books.blocks(batches, books.memos()):
            digits = np.stack([entry for _, entry, _ in found], axis=1).astype(np.uint8)
            error = sum(distance.astype(object) for _, _, distance in found)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"),
                    rows.column("label"),
                    pa.array([row.tobytes().hex() for row in digits], pa.string()),
                    pa.array([min(int(e), WORST) for e in error], pa.int64()),
                ],
                ["id", "label", "code", "error"],
            )

    return vectors.mapInArrow(coded, f"id long, label {label}, code string, error long")


def _with_label_sums(coded: DataFrame, stages: Stages) -> DataFrame:
    """The error summed over equal labels beside every row.

    Labels that hold a thousandth of all rows or more, at most a thousand of them, are broadcast;
    the others are joined by a shuffle, where none of them can be hot.
    """
    sums = stages.put(
        coded.groupBy("label").agg(
            F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(WORST)).cast("long").alias("label_error"),
            F.count("*").alias("n"),
        )
    )
    often = F.col("n") * 1000 >= sums.select(F.sum("n")).scalar()
    same = F.col("label").eqNullSafe(F.col("known"))
    frequent = F.broadcast(sums.where(often).select(F.col("label").alias("known"), "label_error"))
    rare = sums.where(~often).select(F.col("label").alias("known"), "label_error")
    few = coded.join(frequent, same, "left_anti").join(rare, same)
    return coded.join(frequent, same).unionByName(few).drop("known")


def compressed(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    label: str = "label",
) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` per usable vector.

    Vectors that are null or hold null or non-finite numbers are left out. Vectors of different
    length are ended with zeros to the longest, and that length to a multiple of ``parts``. Integers
    beyond 2^62 count as 2^62, errors above the largest long as that. A missing id counts as the
    largest; rows that repeat an id are rows of their own. With fewer vectors than entries the
    codebooks have as many entries as there are vectors. An empty table gives an empty result.
    Columns beyond the three are not read.
    """
    stages = Stages(vectors.sparkSession)
    rows = usable(vectors, vector, vec_id, label)
    books = fitted(rows, parts, entries, rounds)
    coded = stages.put(encoded(rows, books))
    out = _with_label_sums(coded, stages)
    return stages.last(
        out.select(
            public_id("id").alias("vec_id"),
            "label",
            "code",
            "error",
            "label_error",
            F.lit(books.sha256()).alias("codebooks_sha256"),
        )
    )
