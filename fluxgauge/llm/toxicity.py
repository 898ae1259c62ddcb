"""Toxicity scores of deobfuscated text.

A writer who hides a word sends it through a noisy channel: letters become digits and signs,
letters are repeated, or set apart. Every word of letters with a sign or a doubled letter, and every
run of single letters and signs, is decoded by Viterbi search over the lattice of what each
character may stand for, under a character trigram model of the corpus; no other word has more than
one reading there. The restored text, and the text as it is, are scored by a logistic model over character
n-grams learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgauge.llm.quality_model import sampled
from fluxgauge.llm.tables import keyed, public_id
from fluxgauge.llm.text import LOWER, SEGMENT, SPACE, buffer, lists, slices

#: Most labelled rows the model is fitted on: the bound of the sample.
SAMPLE = 20_000
#: Most n-grams the model weighs.
FEATURES = 4096
SIZE = 5
#: Longest span decoded at once; longer ones are decoded part by part.
SPAN = 96

#: Cost of reading a doubled letter as a single one.
DOUBLE = -3.0

#: The letters that digits and signs stand for.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "li",
    "+": "t",
}

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
#: What may set letters apart: neither letter, sign, digit nor apostrophe.
_GAP = ~(_LETTER | _SIGN)
_GAP[[*range(48, 58), 39]] = False
_APART = re.compile("[^a-z0-9" + re.escape("".join(LEET)) + "'\x80-\U0010ffff]+")
_FOLD = np.where(_LETTER, LOWER, 32).astype(np.uint8)
#: Classes of the character model: 0 no letter, 1-26 a-z, 27 other letters.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a character class after two others, counted over every document.

    A task adds up its trigrams; 28 classes bound the table.
    """

    def run(batches):
        total = np.zeros(32768, np.int64)
        for batch in slices(batches, "text"):
            data, offsets = buffer(batch.column("text"))
            for a in range(0, len(data), SEGMENT):
                c = _CLASS[data[a : a + SEGMENT + 2]]
                if len(c) > 2:
                    total += np.bincount((c[:-2] << 10) | (c[1:-1] << 5) | c[2:], minlength=32768)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"trigram": at, "n": total[at]})

    counts = docs.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    table = np.full(32768, 0.5)
    table[found["trigram"].to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    table = table.reshape(32, 32, 32)
    return np.log(table / table.sum(2, keepdims=True))


class Decoder:
    """Viterbi search over character lattices."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.known: dict[bytes, bytes] = {}
        self.seen: dict[bytes, np.ndarray | None] = {}

    def restore(self, span: bytes) -> bytes:
        found = self.known.get(span)
        if found is None:
            text = span.decode("utf-8", "replace").lower()
            found = "".join(self._decode(text[i : i + SPAN]) for i in range(0, len(text), SPAN)).encode()
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[span] = found
        return found

    def grams(self, span: bytes, wanted: "Wanted | None") -> np.ndarray | None:
        """n-grams of the restored span, or nothing if it reads as it stands."""
        restored = self.restore(span)
        if restored == _FOLD[np.frombuffer(span.decode("utf-8", "replace").lower().encode(), np.uint8)].tobytes():
            return None
        g = grams(np.frombuffer(b" " + restored + b" ", np.uint8))
        return g if wanted is None else g[wanted.likely(g)]

    def all_grams(self, data: np.ndarray, spans: list[tuple[int, int]], wanted: "Wanted | None"):
        """n-grams of every span of ``data`` that reads otherwise, and the number of the span of each; spans that repeat are decoded once."""
        if len(self.seen) > 200_000:
            self.seen.clear()
        raw, seen = data.tobytes(), self.seen
        found, numbers = [], []
        for k, (a, b) in enumerate(spans):
            span = raw[a:b]
            g = seen.get(span, self)
            if g is self:
                g = seen[span] = self.grams(span, wanted)
            if g is not None and len(g):
                found.append(g)
                numbers.append(k)
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(found), np.repeat(np.array(numbers), [len(g) for g in found])

    def _options(self, text: str, i: int, spread: bool, tail: int) -> list[tuple[str, float]]:
        """What character i may stand for, with its cost in the channel; empty: nothing."""
        c = text[i]
        if c.isalpha():
            keep = [(c, -0.05)]
            # A repeated letter may be one that was dragged out; twice is mostly right.
            if i and text[i - 1] == c:
                keep.append(("", -1.0 if c in (text[i + 1 : i + 2], text[i - 2 : i - 1]) else DOUBLE))
            return keep
        if c == "!" and i >= tail:  # a mark behind a word
            return [("i", -0.7), (" ", -0.2)]
        stands = [(letter, -0.7) for letter in LEET.get(c, "")] + [(" ", -6.0 if c in LEET else -0.2)]
        if c in LEET and i and text[i - 1] == c:
            stands.append(("", -0.5))
            return stands
        # Between letters set apart, a gap is most likely the channel's work.
        return [*stands[:-1], (" ", -6.0), ("", -0.1)] if spread and _APART.fullmatch(c) else stands

    def _decode(self, text: str) -> str:
        # Set apart: single letters with gaps between them all along.
        words = [w for w in _APART.split(text) if w]
        spread = len(words) >= 3 and all(len(w) == 1 for w in words)
        tail = len(text.rstrip("!?.,;:\"')]}"))
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for i in range(len(text)):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for letter, cost in self._options(text, i, spread, tail):
                k = 0 if letter == " " else ord(letter) - 96 if "a" <= letter <= "z" else 27
                for (a, b), (score, out) in states.items():
                    if letter:
                        state, value = (b, k), score + cost + self.model[a][b][k]
                    else:
                        state, value = (a, b), score + cost
                    best = after.get(state)
                    if best is None or value > best[0]:
                        after[state] = (value, out + letter)
            states = after
        # A word ends here.
        return max((score + self.model[a][b][0], out) for (a, b), (score, out) in states.items())[1]


def _some(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of ``mask`` are set in each of the spans."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[end] - total[start]


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, cut where documents end."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def suspicious_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Spans the channel may have touched: words of letters with a sign or a doubled letter, and
    three or more letters and signs in a row that stand alone, whatever the gaps between them."""
    if not len(data):
        return []
    letter, sign = _LETTER[data], _SIGN[data]
    plain = letter & (data < 128)
    low = LOWER[data]
    twice = np.zeros(len(data), bool)
    twice[1:] = plain[1:] & (low[1:] == low[:-1])
    start, end = _runs(~SPACE[data], offsets)
    # The first byte of a word repeats none of it.
    flagged = (_some(letter, start, end) > 0) & ((_some(sign, start, end) > 0) | (_some(twice, start + 1, end) > 0))
    # Marks around a word that stand for no letter are not part of it.
    core = np.flatnonzero(letter | sign)
    inner = core[np.searchsorted(core, start[flagged])], core[np.searchsorted(core, end[flagged]) - 1] + 1
    spans = list(zip(inner[0].tolist(), inner[1].tolist()))
    start, end = _runs(~_GAP[data], offsets)
    alone = (end - start == 1) & (plain | sign)[start]
    # Runs of such tokens within one document.
    document = np.searchsorted(offsets, start, side="right")
    cuts = np.flatnonzero(document[1:] != document[:-1]) + 1 if len(start) else np.zeros(0, np.int64)
    a, b = _runs(alone, cuts) if len(start) else (cuts, cuts)
    apart = (b - a >= 3) & (_some(plain[start], a, b) > 0)
    spans += zip(start[a[apart]].tolist(), end[b[apart] - 1].tolist())
    return sorted(spans)


def grams(data: np.ndarray) -> np.ndarray:
    """Every run of ``SIZE`` bytes, letters folded and other characters as spaces, in one number."""
    folded = _FOLD[data].astype(np.uint64)
    n = len(folded) - SIZE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SIZE):
        out |= folded[k : k + n] << np.uint64(8 * k)
    return out


def document_grams(batch: pa.RecordBatch, decoder: Decoder, wanted: "Wanted | None" = None):
    """n-grams of the texts and of their restored spans, and the document of each."""
    data, offsets = buffer(batch.column("text"))
    found, owner = [], []

    for at in range(0, len(data), SEGMENT):
        g = grams(data[at : at + SEGMENT + SIZE - 1])
        keep = wanted.likely(g) if wanted is not None else np.arange(len(g))
        first = np.searchsorted(offsets, keep + at, side="right") - 1
        inside = keep + at + SIZE <= offsets[first + 1]
        found.append(g[keep][inside])
        owner.append(first[inside])
    spans = suspicious_spans(data, offsets)
    g, number = decoder.all_grams(data, spans, wanted)
    found.append(g)
    owner.append(np.searchsorted(offsets, np.array([a for a, _ in spans], np.int64)[number], side="right") - 1)
    return np.concatenate(found), np.concatenate(owner).astype(np.int64)


class Wanted:
    """The n-grams the model weighs, with a small table that rules most others out."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self._bits = np.zeros(1 << 16, bool)
        self._bits[self._hash(keys)] = True

    @staticmethod
    def _hash(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def likely(self, g: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self._bits[self._hash(g)])

    def features(self, batch: pa.RecordBatch, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature) pairs of a batch."""
        g, owner = document_grams(batch, decoder, self)
        if not len(g) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        hit = self.keys[at] == g
        pair = np.unique(owner[hit] * len(self.keys) + at[hit])
        return pair // len(self.keys), pair % len(self.keys)


def _telling_grams(rows: DataFrame, model: np.ndarray) -> np.ndarray:
    """The n-grams that stand in toxic documents far more often than in others."""

    def run(batches):
        decoder = Decoder(model)
        for batch in slices(batches, "text"):
            g, owner = document_grams(batch, decoder)
            order = np.lexsort((g, owner))
            g, owner = g[order], owner[order]
            once = np.ones(len(g), bool)
            once[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
            label = batch.column("label").to_numpy()[owner[once]]
            keys, where = np.unique(g[once], return_inverse=True)
            toxic = np.bincount(where, weights=label, minlength=len(keys)).astype(np.int64)
            every = np.bincount(where, minlength=len(keys))
            yield pa.RecordBatch.from_pydict({"gram": keys.view(np.int64), "toxic": toxic, "n": every})

    sums = rows.agg(F.sum("label"), F.count("*")).first()
    n1, n = float(sums[0] or 0), float(sums[1] or 0)
    if not n1 or n1 == n:
        return np.zeros(0, np.uint64)
    counts = rows.mapInArrow(run, "gram long, toxic long, n long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    share, base = F.col("toxic") / n1, (F.col("n") - F.col("toxic")) / (n - n1)
    pooled = F.col("n") / n
    z = (share - base) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n1 + 1 / (n - n1)))
    top = counts.where("toxic >= 4").withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "gram").limit(FEATURES)
    return np.sort(top.select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64))


def logistic(document, feature, label, width: int, rounds: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Weights and constant (last) of a logistic model, by gradient steps with momentum."""
    n = len(label)
    weight, constant, speed, pull = np.zeros(width), 0.0, np.zeros(width), 0.0
    for _ in range(rounds):
        z = constant + np.bincount(document, weights=weight[feature], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
        slope = np.bincount(feature, weights=error[document], minlength=width) / n + decay * weight
        speed, pull = 0.9 * speed - 0.5 * slope, 0.9 * pull - 0.5 * error.mean()
        weight, constant = weight + speed, constant + pull
    return np.append(weight, constant)


def fitted(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character model, n-grams, weights). Without labels of both kinds, a constant."""
    model = character_model(docs)
    rows = sampled(docs, labels, "toxic", train, sample).select("text", "label")
    keys = _telling_grams(rows, model)

    def run(batches):
        decoder, wanted = Decoder(model), Wanted(keys)
        for batch in slices(batches, "text"):
            document, feature = wanted.features(batch, decoder)
            counts = np.bincount(document, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists(feature, counts, pa.int64())], ["label", "feature"])

    table = rows.mapInArrow(run, "label int, feature array<long>").toArrow()
    label = table["label"].to_numpy().astype(np.float64)
    hits = table["feature"].combine_chunks()
    counts = np.diff(np.asarray(hits.offsets)) if len(label) else np.zeros(0, np.int64)
    weights = (
        logistic(np.repeat(np.arange(len(label)), counts), hits.flatten().to_numpy(), label, len(keys))
        if len(label)
        else np.array([0.0])
    )
    return model, keys, weights


def scored(docs: DataFrame, model: tuple) -> DataFrame:
    """``(id, score)`` for every row of ``docs(id, text)``; texts without n-grams get the constant's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        characters, keys, weights = shared.value
        decoder, wanted = Decoder(characters), Wanted(keys)
        for batch in slices(batches, "text"):
            document, feature = wanted.features(batch, decoder)
            z = np.bincount(document, weights=weights[feature], minlength=batch.num_rows) + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["id", "score"])

    return docs.select("id", "text").mapInArrow(run, "id long, score double")


def restored(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """``(doc_id, restored)``: texts with every suspicious span decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        decoder = Decoder(shared.value[0])
        for batch in slices(batches, "text"):
            data, offsets = buffer(batch.column("text"))
            spans = suspicious_spans(data, offsets)
            out = []
            for d in range(batch.num_rows):
                at, parts = int(offsets[d]), []
                for a, b in spans:
                    if at <= a and b <= offsets[d + 1]:
                        parts += [data[at:a].tobytes(), decoder.restore(data[a:b].tobytes())]
                        at = b
                out.append((b"".join(parts) + data[at : offsets[d + 1]].tobytes()).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "restored"])

    return keyed(docs, text).select("id", "text").mapInArrow(run, "id long, restored string").select(public_id("id").alias("doc_id"), "restored")


def toxicity_report(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """``doc_id, held_out, score, predicted``; ``held_out`` is a condition on ``doc_id``.

    Null and empty texts have no n-grams. Rows without an id are never in the sample and are scored
    like all others; repeated rows are scored each. An empty table gives an empty result.
    """
    model = fitted(docs, labels, ~held_out)
    return (
        scored(keyed(docs), model)
        .select(public_id("id").alias("doc_id"), "score")
        .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
