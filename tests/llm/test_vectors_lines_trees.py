"""Vector codes, line dedup and the Merkle manifest against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fluxgauge.llm import line_dedup, merkle, vector_code
from fluxgauge.llm.perfect_hash import PerfectHash
from fluxgauge.llm.tables import Stages

SF = "/root/testdata/sf0.001"


# Vector codes


def plain_codes(rows, parts, entries, rounds):
    """``{index: (code, error, label_error)}`` and the digest, by comparing all with all."""
    kept = [(k, i, v, la) for k, (i, v, la) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v, _ in kept), default=0) // parts)
    ints = []
    for _, _, v, _ in kept:
        v = list(v) + [0.0] * (width * parts - len(v))
        ints.append([max(-(2**62), min(2**62, int(np.floor(x * 256)) if abs(x) < 1e300 else int(np.sign(x)) * 2**62)) for x in v])
    order = sorted(range(len(kept)), key=lambda r: (kept[r][1] is None, kept[r][1] or 0, list(kept[r][2])))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[cut[r][p] for r in order[:entries]] for p in range(parts)]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [assign(row[p], books[p])[1] for row in cut]
            for e in set(chosen):
                own = [row[p] for row, c in zip(cut, chosen) if c == e]
                books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    out, labels = {}, {}
    for (k, _, _, label), row in zip(kept, cut):
        found = [assign(row[p], books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in found), 2**63 - 1)
        out[k] = ["".join(f"{e:02x}" for _, e in found), error, label]
        labels[label] = labels.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return {k: (c, e, min(labels[la], 2**63 - 1)) for k, (c, e, la) in out.items()}, digest


def run_codes(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return vector_code.compressed(df.repartition(3), **how).collect()


def check_codes(spark, rows, **how):
    want, digest = plain_codes(rows, **how)
    got = run_codes(spark, rows, **how)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == sorted(
        (rows[k][0] is None, rows[k][0] or 0, *v) for k, v in want.items()
    )
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_codes_equal_the_plain_search(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], int(rng.integers(0, 3))) for i in range(300)]
    check_codes(spark, rows, parts=4, entries=16, rounds=2)


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 7, [float(x) for x in rng.integers(-2, 3, 6)], None if i % 3 else i % 2) for i in range(40)]
    rows += [(None, [0.5] * 6, None), (None, [0.25] * 5, 1), (50, None, 1), (51, [1.0, None] + [0.0] * 4, 1)]
    rows += [(52, [float("nan")] * 6, 0), (53, [float("inf")] + [0.0] * 5, 0), (54, [], 0), (55, [0.1] * 7, None)]
    rows += [rows[0]] * 5
    check_codes(spark, rows, parts=4, entries=10, rounds=2)


def test_codes_of_huge_numbers(spark):
    rows = [(i, [x, -x, 1.0, 0.0], 0) for i, x in enumerate([1e6, 3e8, -1e15, 1e17, 1e300, 0.0, 1.5])]
    check_codes(spark, rows, parts=2, entries=3, rounds=2)


def test_codes_of_few_or_no_vectors(spark):
    assert run_codes(spark, [], parts=4, entries=16, rounds=2) == []
    assert run_codes(spark, [(1, None, 1)], parts=4, entries=16, rounds=2) == []
    check_codes(spark, [(1, [1.0, 2.0], None)], parts=4, entries=16, rounds=2)
    check_codes(spark, [(1, [], None), (2, [], 1)], parts=4, entries=16, rounds=2)


def test_clashing_columns_are_not_read(spark):
    rows = [(i, [float(i), 1.0], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("id", "vec", "code", "error", "known", "n"):
        df = df.selectExpr("*", f"'x' AS {name}")
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    how = dict(parts=2, entries=3, rounds=1)
    assert sorted(vector_code.compressed(df, **how).collect()) == sorted(vector_code.compressed(plain, **how).collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5), st.integers(1, 40), st.sampled_from([1, 30, 10**6, 2**40]))
def test_undominated_entries_hold_the_nearest(seed, width, entries, spread):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread + 1, (entries, width))
    memo = vector_code.CellMemo(book, capacity=3)
    for _ in range(3):
        x = rng.integers(-spread, spread + 1, (50, width))
        entry, distance = memo.nearest(x)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in book] for v in x]
        assert entry.tolist() == [row.index(min(row)) for row in exact]
        assert [int(d) for d in distance] == [min(row) for row in exact]


def test_a_cell_is_decided_once(spark):
    rng = np.random.default_rng(1)
    memo = vector_code.CellMemo(rng.integers(-100, 100, (64, 4)))
    x = rng.integers(-100, 100, (4000, 4))
    memo.nearest(x)
    known = len(memo.cells)
    memo.nearest(x)
    assert len(memo.cells) == known < 4000
    assert memo.evaluated < 2 * 4000 * 64 / 2


# Perfect hashing and lines


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3000), st.booleans())
def test_perfect_hash_numbers_every_key_once(seed, n, alike):
    rng = np.random.default_rng(seed)
    one = rng.integers(0, 2**64, n, dtype=np.uint64) if not alike else np.zeros(n, np.uint64)
    two = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    one = one[: len(two)]
    function = PerfectHash.build(one, two)
    again = PerfectHash(function.sizes, function.bits)
    assert sorted(again.numbers(one, two).tolist()) == list(range(len(two)))
    assert n < 500 or len(function.bits) * 8 < 4 * len(two)


def plain_key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate({c: c + 32 for c in range(65, 91)})


def plain_lines(rows, least=10, least_holders=2):
    far = 2**63 - 1
    held = {}
    for i, text in rows:
        for key in {plain_key(x) for x in (text or "").split("\n")}:
            if len(key) >= least:
                held.setdefault(key, []).append(far if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = far if i is None else i
        kept = [x for x in lines if not (len(h := held.get(plain_key(x), [])) >= least_holders and own > min(h))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *[str(x) for x in r]))


def run_lines(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in line_dedup.without_repeated_lines(df, **how).collect()]


LINES = [
    (5, "A line that repeats\nshort\n  a LINE that repeats \t\nown line of five"),
    (2, "first of them\na line that repeats"),
    (9, "a line that repeats\n\n\nshort\n"),
    (None, "a line that repeats\nline without an id"),
    (None, "line without an id\n"),
    (7, None),
    (8, ""),
    (11, "\n"),
    (12, "äöü äöü äö\nnine äöüß"),
    (13, "ÄÖÜ äöü äö\näöü äöü äö\nNINE äöüß"),
    (14, "line\r\nwindows line end\r\n"),
    (15, "windows line end\n \x0b windows line end \x0c"),
    (16, "no break space line \nno break space line"),
    (17, "no break space line"),
]


def test_lines_equal_the_plain_version(spark):
    assert order(run_lines(spark, LINES)) == order(plain_lines(LINES))
    assert order(run_lines(spark, LINES, least=1, least_holders=3)) == order(plain_lines(LINES, 1, 3))


def test_lines_of_repeated_rows_and_empty_tables(spark):
    rows = LINES + LINES[:3] * 4 + [(2, "another text of two\na line that repeats")]
    assert order(run_lines(spark, rows)) == order(plain_lines(rows))
    assert run_lines(spark, []) == []
    assert order(run_lines(spark, [(1, None), (2, "")])) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_small_shards_in_copies_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = ["alpha beta gamma", "delta epsilon zeta", "the most common of lines", *[f"line number {k:04d}" for k in range(60)]]
    rows = [(i, "\n".join([words[2], *rng.choice(words, 6), f"own line of {i}"])) for i in range(400)]
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 40)
    monkeypatch.setattr(line_dedup, "SHARD_LOADS", 50)
    assert order(run_lines(spark, rows)) == order(plain_lines(rows))


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEGMENT", 50)
    long = "x" * 300 + "\n" + "\n".join(f"line {k % 40:06d} of it" for k in range(500))
    rows = [(1, long), (2, "line 000003 of it\n" + long), (3, "x" * 300)]
    assert order(run_lines(spark, rows)) == order(plain_lines(rows))
    data = long.encode()
    lines = line_dedup.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert lines.length.tolist() == [len(x) for x in long.split("\n")]


def test_fingerprints_turn_foreign_keys_away(spark):
    keys = spark.range(1000).selectExpr("id", "id AS th", "xxhash64(id) AS one", "xxhash64(id, 7) AS two", "id AS turn")
    row = line_dedup.sharded(line_dedup.holders(keys), 1).first().asDict()
    shard = line_dedup.Shard(row)
    rng = np.random.default_rng(5)
    held, _ = shard.look_up(*rng.integers(0, 2**64, (2, 5000), dtype=np.uint64))
    assert not held.any()
    assert shard.counts.itemsize == 1


def test_lines_beside_clashing_columns(spark):
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    for name in ("id", "th", "row", "gone", "kept", "shard", "copy"):
        df = df.selectExpr("*", f"'x' AS {name}")
    assert order(tuple(r) for r in line_dedup.without_repeated_lines(df).collect()) == order(plain_lines(LINES))


# Merkle manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, arity):
    """Levels of digests, and per leaf its proof: (before, after) per level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h("".join(low[i : i + arity])) for i in range(0, len(low), arity)])
    proofs = []
    for i in range(len(leaves)):
        steps = []
        for low in levels[:-1]:
            run = i // arity * arity
            steps.append((low[run:i], low[i + 1 : run + arity]))
            i //= arity
        proofs.append(steps)
    return levels[-1][0], proofs


def plain_manifest(rows, later, arity=3):
    trees = {}
    for row, text in zip(rows, later):
        leaf = plain_leaf(row)
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf, plain_leaf((*row[:4], text)), row[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda t: t[:3])
        built[s] = plain_tree([t[2] for t in trees[s]], arity)
    root, above = plain_tree([built[s][0] for s in names], arity) if names else (None, [])
    out = []
    for s, rest in zip(names, above):
        subroot, proofs = built[s]
        for (_, _, leaf, changed, doc_id), steps in zip(trees[s], proofs):
            whole = steps + rest
            folded = changed
            for before, after in whole:
                folded = h("".join([*before, folded, *after]))
            flat = "".join(x for before, after in whole for x in before + after)
            out.append((doc_id, leaf, subroot, root, h(flat), folded, folded == root))
    return out


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def documents(n, sources, seed=1):
    rng = np.random.default_rng(seed)
    return [
        (i, sources[int(rng.integers(len(sources)))], None if i % 5 == 0 else "de", None if i % 7 == 0 else i, f"text {i}\nof it" if i % 3 else None)
        for i in range(n)
    ]


def run_manifest(spark, rows, arity=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 != 0, F.lit(True))
    later = F.when(odd, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("")))
    return [tuple(r) for r in merkle.manifest(df, later, arity).collect()]


def tampered(rows):
    return [
        t if i is None or t is None or zlib.crc32(str(i).encode()) % 2 else t.replace("\n", "") for i, _, _, _, t in rows
    ]


@pytest.mark.parametrize("n, sources, arity", [(1, ["a"], 3), (28, ["a", None, "ä", "", "Z"], 3), (11, ["a", "b"], 2), (18, ["one"], 4)])
def test_manifest_equals_the_plain_trees(spark, n, sources, arity):
    rows = documents(n, sources)
    got = run_manifest(spark, rows, arity)
    assert sorted(got) == sorted(plain_manifest(rows, tampered(rows), arity))
    assert any(r[-1] for r in got)


def test_many_sources(spark):
    rows = documents(40, [f"s{k}" for k in range(25)])
    assert sorted(run_manifest(spark, rows)) == sorted(plain_manifest(rows, tampered(rows)))


def test_manifest_of_repeated_rows_nulls_and_nothing(spark):
    rows = documents(9, ["a", None]) + [(None, None, None, None, None)] * 3 + [(4, "a", "x", 1, "")] * 2 + [(-3, "a", "", 0, "ß\n")]
    got, want = run_manifest(spark, rows), plain_manifest(rows, tampered(rows))
    assert order(got) == order(want)
    assert run_manifest(spark, []) == []


def test_an_untouched_table_verifies(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("sid", "idx", "n", "digest", "seq", "part", "later", "steps"):
        df = df.selectExpr("*", f"'x' AS {name}")
    out = merkle.manifest(df)
    assert out.where("NOT verified").isEmpty()
    assert out.select("root").distinct().count() == 1
    changed = merkle.manifest(df.selectExpr("doc_id", "source", "lang", "n_chars", "concat(text, '!') AS text"))
    assert changed.first().root != out.first().root


def test_stored_levels_are_deleted(spark, monkeypatch):
    kept = []
    last = Stages.last

    def watched(self, df):
        out = last(self, df)
        kept.append(len(self._paths))
        return out

    monkeypatch.setattr(Stages, "last", watched)
    run_manifest(spark, documents(20, ["a", "b"]))
    assert kept == [1]
