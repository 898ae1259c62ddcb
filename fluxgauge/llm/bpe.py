"""Byte-level BPE by speculation and verification.

Per distinct piece of text (the pre-tokenizer's words), greedy longest match in the vocabulary
proposes tokens. A sequence of tokens is the BPE encoding if and only if each adjacent pair is the
encoding of its own two tokens, so vectorised checks of the distinct adjacent pairs verify the
proposals. Only pieces with a failing pair undergo exact merging.

The vocabulary is a file on every machine, named by a path; each task reads it once.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fluxgauge.llm.text import lists, slices

#: Fixed value: the pre-tokenizer's pattern of this kind of vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

NEVER = np.int64(2**40)
#: Distinct pieces a task remembers between batches; then it starts anew.
REMEMBERED = 400_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for i, b in enumerate(sorted(set(range(256)) - set(plain))):
        letters[chr(256 + i)] = b
    return letters


class Vocabulary:
    """Tokens, merge ranks and the spines of every token's merge tree."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in stored["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in stored["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]]
        left = np.array([self.ids[raw[a]] for a, _ in merges], np.int64)
        right = np.array([self.ids[raw[b]] for _, b in merges], np.int64)
        made = np.array([self.ids[raw[a] + raw[b]] for a, b in merges], np.int64)
        self.rank = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(zip(left, right, made))}
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self._keys, self._ranks, self._size = key[order], order.astype(np.int64), size
        # How a token arises: the first merge that makes it.
        self._made = np.full(size, NEVER)
        parts = np.full((size, 2), -1, np.int64)
        for r in range(len(merges) - 1, -1, -1):
            self._made[made[r]] = r
            parts[made[r]] = left[r], right[r]
        self._spines = [self._spine(parts[:, side]) for side in (1, 0)]
        self.longest: dict[bytes, int] = {}
        for token in self.ids:
            head = token[:2]
            self.longest[head] = max(self.longest.get(head, 0), len(token))

    def _spine(self, child: np.ndarray) -> np.ndarray:
        """Per token, from its outer byte up to itself: the tokens at one edge of its merge tree."""
        chains = [np.arange(len(child))]
        while (chains[-1] >= 0).any():
            last = chains[-1]
            chains.append(np.where(last >= 0, child[np.maximum(last, 0)], -1))
        table = np.stack(chains[:-1], 1)
        depth = (table >= 0).sum(1)
        at = depth[:, None] - 1 - np.arange(table.shape[1] + 1)[None, :]
        flipped = np.take_along_axis(table, np.maximum(at, 0)[:, : table.shape[1] + 1], 1)
        return np.where(at >= 0, flipped, -1)

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self._size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does no merge ever cross the border between the tokens, for each pair?

        Follows time: the neighbours of the border climb their tokens' spines, the one that is
        merged earlier first. The pair fails if the two neighbours would merge before either is
        merged into its own token: strictly before the left one, whose merge stands further left
        and so goes first among equals.
        """
        rows = np.arange(len(a))
        left, right = self._spines[0][a], self._spines[1][b]
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        good = np.ones(len(a), bool)
        active = np.ones(len(a), bool)
        while active.any():
            x, y = left[rows, i], right[rows, j]
            up_x, up_y = left[rows, i + 1], right[rows, j + 1]
            rx = np.where(up_x >= 0, self._made[np.maximum(up_x, 0)], NEVER)
            ry = np.where(up_y >= 0, self._made[np.maximum(up_y, 0)], NEVER)
            cross = self._merge_rank(x, y)
            bad = active & (cross < NEVER) & (cross < rx) & (cross <= ry)
            good &= ~bad
            active &= ~bad & ((rx < NEVER) | (ry < NEVER))
            first = rx <= ry
            i += active & first
            j += active & ~first
        return good

    def propose(self, piece: bytes) -> list[int]:
        """Greedy longest match; single bytes are always tokens."""
        out, at, n = [], 0, len(piece)
        ids, longest = self.ids, self.longest
        while at < n:
            to = min(n, at + longest.get(piece[at : at + 2], 1))
            while (found := ids.get(piece[at:to])) is None:
                to -= 1
            out.append(found)
            at = to
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Exact BPE of one piece: the lowest rank first, the leftmost among equals.

        A heap of candidate merges over a linked list, so that a very long piece costs n log n.
        """
        import heapq

        tokens = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        after = list(range(1, len(tokens))) + [-1]
        before = list(range(-1, len(tokens) - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j >= 0 and (found := self.rank.get((tokens[i], tokens[j]))):
                heapq.heappush(heap, (found[0], i, tokens[i], tokens[j], found[1]))

        for i in range(len(tokens) - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in tokens if t >= 0]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes pieces; remembers their tokens and which pairs of tokens may stand together."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self._splits = regex.compile("|".join(regex.escape(s) for s in self.vocabulary.special) or r"(?!)")

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text; special tokens in it stand as they are."""
        special = self.vocabulary.special
        if not any(s in text for s in special):
            return PIECES.findall(text)
        out, at = [], 0
        for hit in self._splits.finditer(text):
            out += PIECES.findall(text[at : hit.start()])
            out.append(hit.group())
            at = hit.end()
        return out + PIECES.findall(text[at:])

    def learn(self, pieces: set[str]) -> None:
        """Find the tokens of pieces not seen before."""
        v = self.vocabulary
        fresh = [p for p in pieces if p not in self.known]
        if not fresh:
            return
        raw = [p.encode() for p in fresh]
        proposed = [[v.special[p]] if p in v.special else v.propose(b) for p, b in zip(fresh, raw)]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for tokens in proposed for t in tokens), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(fresh)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys = flat[inner] * 65536 + flat[inner + 1]
        distinct, where = np.unique(keys, return_inverse=True)
        good = np.fromiter((self.pairs.get(k, -1) for k in distinct.tolist()), np.int8, len(distinct))
        new = np.flatnonzero(good < 0)
        if len(new):
            good[new] = v.compatible(distinct[new] // 65536, distinct[new] % 65536)
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            self.pairs.update(zip(distinct[new].tolist(), good[new].tolist()))
        for k in np.unique(owner[inner[good[where] == 0]]).tolist():
            proposed[k] = v.merged(raw[k])
        if len(self.known) > REMEMBERED:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        self.known.update(zip(fresh, proposed))

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        return [[t for p in pieces for t in known[p]] for pieces in cut]


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text as an array column; null texts have none.

    Special tokens of the vocabulary are recognised in the text; none are added. All other columns
    stay as they are; one named ``ids`` is replaced.
    """
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = Encoder(path)
        for batch in slices(batches, text):
            found = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((t for tokens in found for t in tokens), np.int32, int(counts.sum()))
            columns = [*batch.columns, lists(flat, counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of its token ids, special tokens included; null ids give an empty text.

    Bytes that are not UTF-8 become replacement characters. Other columns stay as they are.
    """
    docs = docs.drop(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        tokens = vocabulary(path).bytes
        size = np.array([len(t) for t in tokens], np.int64)
        start = np.concatenate(([0], np.cumsum(size)))
        table = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            # A few hundred thousand tokens at a time.
            counts = np.array([len(x) if x.is_valid else 0 for x in batch.column(ids)], np.int64)
            ends = np.cumsum(counts)
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + 500_000, side="right")))
                part = batch.slice(at, to - at)
                flat = part.column(ids).flatten().to_numpy(zero_copy_only=False)
                length = size[flat]
                total = np.concatenate(([0], np.cumsum(length)))
                data = table[np.repeat(start[flat] - total[:-1], length) + np.arange(total[-1])].tobytes()
                border = total[np.concatenate(([0], np.cumsum(counts[at:to])))]
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(border, border[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text])
                at = to

    return docs.mapInArrow(run, schema)
