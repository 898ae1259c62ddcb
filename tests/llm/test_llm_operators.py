"""The training-data operators against plain versions, on small and odd inputs."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from fluxgauge.llm import (
    bpe,
    exact_dedup,
    jaccard_join,
    link_trust,
    mixing,
    quality_model,
    quality_rules,
    substring_dedup,
    toxicity,
    warc_zip,
)
from fluxgauge.llm.graph import components
from fluxgauge.llm.queries import held_out, tokenizer_path
from fluxgauge.llm.tables import Stages, keyed
from fluxgauge.llm.text import buffer, slices, split_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_texts():
    """Copies, near copies, shared passages, repeats, nulls, empty, short and long texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(200), say(40)
    near = [" ".join(w if k != j * 3 else "zz" for k, w in enumerate(base.split())) for j in range(12)]
    texts = [None, "", "  \n\t ", "one", "one two", "One  TWO", base, base.replace(" ", "\n"), *near, near[3]]
    texts += [say(30) + " " + passage + "\n" + say(20) for _ in range(6)] + [passage, say(9000), "a b c " * 400, "\x0b\x0c x y"]
    return texts + [base + " " + say(3), base + " " + say(60)]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_words_match_a_regular_expression(odd_texts):
    batch = pa.RecordBatch.from_pydict({"text": odd_texts})
    found = []
    for part in slices([batch], "text", 500):
        data, offsets = buffer(part.column("text"))
        words = split_words(data, offsets)
        raw = [data[a:b].tobytes().decode() for a, b in zip(words.start, words.end)]
        found += [raw[a:b] for a, b in zip(words.first, words.first[1:])]
        assert len(set(zip(raw, words.hash.tolist()))) == len(set(raw)) == len(set(words.hash.tolist()))
    assert found == [WORD.findall(t or "") for t in odd_texts]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Stages(spark)).collect()}
    groups = [set(range(51)), set(range(100, 140)), {200, 201, 202}]
    assert set(got) == set().union(*groups)
    assert [len({got[n] for n in g}) for g in groups] == [1, 1, 1] and len(set(got.values())) == 3
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty, Stages(spark)).count() == 0


def jaccard_classes(texts, size, num, den):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard_classes_are_those_of_all_pairs(spark, odd_texts, size, num, den):
    got = jaccard_join.component_report(table(spark, odd_texts), shingle=size, similarity=(num, den))
    assert by_id(got, "n_shingles", "component_id") == jaccard_classes(odd_texts, size, num, den)


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (2, 1, 2)])
def test_jaccard_links_are_all_pairs_of_different_sets(spark, odd_texts, size, num, den):
    texts = odd_texts + odd_texts[:3]
    links, members = jaccard_join.linked_pairs(table(spark, texts), shingle=size, similarity=(num, den))
    rows = {r["doc_id"]: r for r in members.collect()}
    found = {(r["set_a"], r["set_b"]) for r in links.collect()}
    assert len(found) == links.count() and all(a < b for a, b in found)
    words = [[x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")] for t in texts]
    sets = [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)) if w) for w in words]
    want = {
        frozenset((x, y)) for x in sets for y in sets if x and y and x != y and den * len(x & y) >= num * len(x | y)
    }
    by_set = {rows[k]["set"]: sets[k] for k in rows if sets[k]}
    assert {frozenset((by_set[a], by_set[b])) for a, b in found} == want and len(found) == len(want)
    for k, r in rows.items():
        assert (r["set"] is None) == (not sets[k]) and r["n_shingles"] == len(sets[k])
        assert r["n_links"] == sum(sets[k] in pair for pair in want)


def test_wide_counts_bound_the_difference_of_sets_of_any_size():
    rng = np.random.default_rng(5)
    for n, m in ((1, 3), (400, 470), (5_000, 6_100), (40_000, 41_000), (3_000, 60_000)):
        pool = rng.integers(0, 2**64, n + m, dtype=np.uint64)
        x, y = np.unique(pool[: max(n, m)]), np.unique(pool[min(n, m) // 2 : min(n, m) // 2 + min(n, m)])
        wide_x, wide_y = jaccard_join.wide_counts(x), jaccard_join.wide_counts(y)
        l1 = jaccard_join.wide_distance(wide_x, wide_y)
        assert l1 == jaccard_join.wide_distance(wide_y, wide_x) <= len(np.setxor1d(x, y))
        assert len(wide_x) >= len(x) / jaccard_join.BIN_LOAD
        # Unrelated sets of one size are told apart at any size from some hundred shingles on.
        u, v = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        l1 = jaccard_join.wide_distance(jaccard_join.wide_counts(u), jaccard_join.wide_counts(v))
        assert n < 400 or not jaccard_join.within(np.array([l1]), np.array([2 * n]), (80, 100))[0]
    same = np.zeros(1000, np.uint64)
    assert jaccard_join.wide_distance(jaccard_join.wide_counts(same), jaccard_join.wide_counts(same[:600])) <= 400


def test_jaccard_crowded_cells_use_pivots_and_blocks(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_CELL", 1)
    got = jaccard_join.linked_classes(table(spark, odd_texts), shingle=2, similarity=(1, 2), region=2)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}
    assert got == jaccard_classes(odd_texts, 2, 1, 2)


def test_jaccard_cells_may_span_arrow_batches(spark, odd_texts):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        got = jaccard_join.component_report(table(spark, odd_texts), shingle=2, similarity=(1, 2))
        assert by_id(got, "n_shingles", "component_id") == jaccard_classes(odd_texts, 2, 1, 2)
    finally:
        spark.conf.set(key, before)


def test_size_windows_lose_no_pair(spark):
    """Cells of random sizes, members in order of size, cut into batches anywhere."""
    rng = np.random.default_rng(5)
    rows = 300
    cell, label = np.sort(rng.integers(0, 12, rows)), rng.integers(0, 40, rows)
    base = rng.integers(0, 6, (20, jaccard_join.BINS))
    bins = np.maximum(base[rng.integers(0, 20, rows)] + (rng.random((rows, jaccard_join.BINS)) < 0.05), 0)
    n = bins.sum(1)
    frame = [(int(c), i, int(g), int(k), bytearray(b.astype(np.uint8))) for i, (c, g, k, b) in enumerate(zip(cell, label, n, bins))]
    members = spark.createDataFrame(frame, "cell long, node long, label long, n long, bins binary")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = sorted(tuple(r) for r in jaccard_join._cell_pairs(members, (90, 100)).distinct().collect())
    finally:
        spark.conf.set(key, before)
    l1 = np.abs(bins[:, None] - bins[None]).sum(-1)
    fits = jaccard_join.within(l1, n[:, None] + n[None], (90, 100)) & (np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * 90)
    want = fits & (cell[:, None] == cell) & (label[:, None] != label)
    assert got == [(a, b) for a, b in np.argwhere(want).tolist() if a < b] and len(got) > 20


def test_region_pairs_lose_no_pair():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 40, (30, jaccard_join.BINS))
    bins = np.concatenate([np.maximum(c + rng.integers(-1, 2, (20, jaccard_join.BINS)), 0) for c in centres])
    n, group = bins.sum(1), np.arange(len(bins))
    got = jaccard_join.region_pairs(bins, n, group, (90, 100), np.arange(len(bins)), leaf=16)
    got = {tuple(sorted(p)) for x, y in got for p in zip(x.tolist(), y.tolist())}
    l1 = np.abs(bins[:, None] - bins[None]).sum(-1)
    want = jaccard_join.within(l1, n[:, None] + n[None], (90, 100))
    assert got == {(i, j) for i, j in zip(*np.nonzero(want)) if i < j}


def test_one_document_of_each_class_stays(spark, odd_texts):
    docs = table(spark, odd_texts).union(table(spark, odd_texts[6:7], [6]))
    kept = jaccard_join.one_per_class(docs)
    classes = jaccard_classes(odd_texts, 5, 80, 100)
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert kept.columns == docs.columns and ids == sorted(i for i, (n, c) in classes.items() if i == c)


def plain_substring(texts, window=13):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def test_substring_dedup_matches_all_windows(spark, odd_texts):
    got = substring_dedup.without_repeats(table(spark, odd_texts)).cache()
    assert by_id(got, "n_words", "n_removed", "kept") == plain_substring(odd_texts)
    words = [WORD.findall(t or "") for t in odd_texts]
    factors = [(r.doc_id, f) for r in got.collect() for f in r.factors]
    assert factors and all(
        f.source < i and f.length >= 13 and words[i][f.start : f.start + f.length] == words[f.source][f.source_start : f.source_start + f.length]
        for i, f in factors
    )


def plain_rules(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    spans = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = set()
    for i in range(len(w) - 2):
        if spans[tuple(w[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), len(w) < 50 or 2 * len(again) > len(w)


def test_substring_dedup_of_rows_that_repeat_or_have_no_id(spark):
    text = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text)] + [(None, text)] * 400 + [(2, other)] * 50 + [(3, other + " end")] * 50 + [(None, "x " + other)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.without_repeats(docs).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        factors = tuple(tuple(f) for f in r.factors)
        seen.setdefault((r.doc_id, r.n_words, r.n_removed, factors), []).append(r)
    counts = {key: len(group) for key, group in seen.items()}
    assert counts == {
        (1, 100, 0, ()): 1,
        (None, 100, 100, ((0, 100, 1, 0),)): 400,
        (2, 40, 0, ()): 50,
        (3, 41, 40, ((0, 40, 2, 0),)): 50,
        (None, 41, 40, ((1, 40, 2, 0),)): 3,
    }


def test_quality_rules_count_like_plain_code(spark, odd_texts):
    texts = [*odd_texts, "x\nx\n\ny\n x", "# a | b <c> " * 30]
    got = quality_rules.judged(table(spark, texts))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_id(got, *columns) == {i: plain_rules(t) for i, t in enumerate(texts)}
    assert not any(r.kept and r.base_failed for r in got.collect())


def test_exact_dedup_and_its_index(spark, odd_texts):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in enumerate(odd_texts):
        groups.setdefault(norm(t), []).append(i)
    index = exact_dedup.DigestIndex(spark, buckets=4)
    docs = table(spark, odd_texts)
    want = {
        i: (groups[norm(t)][0], len(groups[norm(t)]), groups[norm(t)][0] == i, hashlib.sha256(norm(t).encode()).hexdigest())
        for i, t in enumerate(odd_texts)
    }
    for _ in range(2):  # a batch that is run again changes nothing
        assert by_id(exact_dedup.deduplicated(docs, index), "keep_id", "group_size", "kept", "text_sha256") == want
    assert index.read().count() == len(groups)
    later = exact_dedup.deduplicated(table(spark, [odd_texts[6], "new text"], [1000, 1001]), index)
    assert by_id(later, "keep_id", "kept") == {1000: (6, False), 1001: (1001, True)}
    plan = index.read().join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_mix_targets_and_copies(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 0), (None, 500)]
    rows = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes], "missing boolean, source string, source_size long")
    got = {(None if r.missing else r.source): r.target for r in mixing.targets(rows).collect()}
    # Weights 1, 2, 3, 1; b and c stop at their caps, and a and the rest share equally.
    assert got == pytest.approx({"a": 740.0, "b": 30.0, "c": 0.0, None: 740.0})


def test_mix_comes_near_its_targets(spark, odd_texts):
    rng = random.Random(4)
    texts = [" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))) for _ in range(400)] + odd_texts
    docs = table(spark, texts)
    report = mixing.mix_report(docs).collect()
    assert sorted(map(tuple, report)) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, goal, largest = Counter(), {}, Counter()
    for r in report:
        s = source[r.doc_id]
        assert r["size"] == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
        goal[s], largest[s] = r.target, max(largest[s], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 for s in goal)
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(mixed[r.doc_id] * r["size"] == r.taken for r in report)


def test_mix_of_whole_copies_fills_all_buckets(spark, monkeypatch):
    put, seen = Stages.put, []

    def watched(self, df):
        out = put(self, df)
        if "bucket" in df.columns:
            seen.append(out.groupBy("source", "bucket").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(Stages, "put", watched)
    docs = table(spark, ["a b c"] * 900 + [""] * 9).withColumn("source", F.lit("only"))
    report = mixing.mix_report(docs).collect()
    assert seen and max(seen) < 200
    assert all(r.taken == r["size"] for r in report) and len(report) == 909


def test_bpe_equals_the_library(spark, odd_texts):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [*odd_texts, "a<|endoftext|>b <|endoftext|>", "a" * 3000, "it's we'll  \n\n x", "漢字かな é́ 👍🏽", "\x00\x7f"]
    texts += ["".join(rng.choice("ab tes'\n0é漢!") for _ in range(60)) for _ in range(200)]
    library = Tokenizer.from_file(tokenizer_path())
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    docs = table(spark, texts)
    got = bpe.decoded(bpe.encoded(docs, tokenizer_path()), tokenizer_path())
    found = by_id(got, "ids", "decoded", "text")
    assert [found[i][0] for i in range(len(texts))] == want
    assert all(d == (t or "") for _, d, t in found.values())


def test_bpe_pair_checks_agree_with_exact_merging():
    v = bpe.vocabulary(tokenizer_path())
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    good = v.compatible(a, b)
    assert good.any() and not good.all()
    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist()):
        assert ok == (v.merged(v.bytes[x] + v.bytes[y]) == [x, y])


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 40000, "<p>a</p>", "b\r\n\r\nWARC/1.1\r\n", ""]
    rows = [(i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)] + [(None, None, "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc_zip.round_trip(spark, pages, payload=True).collect()
    assert len(got) == len(rows)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    last = {h or "": i for i, h in enumerate(html)}
    for r in got:
        h = "<p>a</p>" if r.page_id is None else html[r.page_id] or ""
        revisit = r.page_id is not None and last[h] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), sha(h))
        assert (r.record_type, r.refers_to) == (("revisit", last[h]) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else h.encode())
    large = warc_zip.round_trip(spark, pages, least_bytes=10).where("record_type = 'revisit'")
    assert large.count() == 0 and warc_zip.round_trip(spark, pages.limit(0)).count() == 0


def test_zip64_directory(tmp_path):
    name, body = b"archive/data.warc.gz", b"payload"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20)
    local += name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    entry += name + extra
    at = len(local)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "a.zip").write_bytes(local + entry + end64 + locator + end)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.zip")) as file:
        (member,) = warc_zip.directory(file)
        assert file.read_at(member.size, member.start) == body
    (tmp_path / "b.zip").write_bytes(b"nothing")
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "b.zip")) as file, pytest.raises(ValueError):
        warc_zip.directory(file)


def test_url_rules_and_trust(spark):
    link = '<a class="x" href="{}">'.format
    rows = [
        (1, "http://Bad.NET/x", None),
        (2, "https://a.example.net/en/x?y", ""),
        (3, "https://shop.com/1", link("http://bad.net/") + link("/own")),
        (4, "https://good.org/fr/", link("//friend.com/2")),
        (5, "https://friend.com", link("http://good.org/fr/a")),
        (6, None, "x"),
        (7, "no scheme/net/", None),
        (8, "http://w.example.com/de/7#t", ""),
        (9, "http://net?x", ""),
        (10, "http://dotnet/", ""),
    ]
    got = by_id(
        link_trust.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumnRenamed("page_id", "doc_id"),
        "host",
        "path",
        "rule",
        "verdict",
    )
    assert got[1] == ("bad.net", "/x", "net/", "block")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3] == ("shop.com", "/1", None, "block")
    assert got[4] == ("good.org", "/fr/", "org/fr/", "allow")
    assert got[5] == ("friend.com", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("w.example.com", "/de/7", "example.com/de/", "block")
    # No rule fits the empty path; distrust reaches the parent of a blocked host.
    assert got[9] == ("net", "", None, "block") and got[10] == ("dotnet", "/", None, "allow")


def test_trust_settles_however_far_the_rules_are(spark):
    link = '<a href="http://{}/">'.format
    # A chain to a blocked host, twenty links long, and random links among hosts that both kinds reach.
    links = [(f"chain{k}.test", f"chain{k - 1}.test" if k else "bad.net") for k in range(20)]
    rng = random.Random(4)
    names = [f"h{k}.test" for k in range(30)]
    links += [(names[k], names[k + 1]) for k in range(29)] + [(names[k + 1], names[k]) for k in range(29)]
    links += [(rng.choice(names), rng.choice(names)) for _ in range(4)]
    links += [("good.org", names[0]), (names[29], "worse.net"), (names[14], "worse.net")]
    links = [x for x in links if x[0] != x[1]]
    rows = [(k, f"http://{a}/fr/", link(b)) for k, (a, b) in enumerate(links)]
    rows += [(len(rows) + k, f"http://{a}/fr/", "") for k, a in enumerate(("bad.net", "worse.net"))]
    got = link_trust.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    verdict = {r.host: r.verdict for r in got}
    assert all(verdict[f"chain{k}.test"] == "block" for k in range(20))
    hosts = sorted({h for x in links for h in x})
    at = {h: k for k, h in enumerate(hosts)}
    edges = np.zeros((len(hosts), len(hosts)))
    for a, b in links:
        edges[at[a], at[b]] += 1

    def rank(edges, seeds):
        share = edges / np.maximum(edges.sum(1, keepdims=True), 1)
        start = np.array([seeds.count(h) / len(seeds) for h in hosts])
        return np.linalg.solve(np.eye(len(hosts)) - link_trust.DAMPING * share.T, (1 - link_trust.DAMPING) * start)

    trust, distrust = rank(edges, ["good.org"]), rank(edges.T, ["bad.net", "worse.net"])
    for h in names:
        assert (verdict[h] == "block") == (distrust[at[h]] > trust[at[h]]), h


SF = "/root/testdata/sf0.01"


def held_out_accuracy(report, labels, column):
    rows = report.where("held_out").join(labels, "doc_id").select("predicted", F.col(column).alias("y")).collect()
    assert len(rows) > 20
    return np.mean([r.predicted == r.y for r in rows]), np.mean([r.y for r in rows])


def test_quality_classifier_on_held_out_rows(spark, odd_texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    report = quality_model.quality_report(docs, labels, held_out(3, 1))
    accuracy, rate = held_out_accuracy(report, labels, "quality")
    assert accuracy > 0.9 and accuracy > max(rate, 1 - rate)
    odd = quality_model.quality_report(table(spark, odd_texts), labels.limit(0), held_out(3, 1)).collect()
    assert len(odd) == len(odd_texts) and all(r.score == 0.5 for r in odd)


def test_toxicity_on_held_out_and_obfuscated_rows(spark, odd_texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    report = toxicity.toxicity_report(docs, labels, held_out(5, 0))
    accuracy, rate = held_out_accuracy(report, labels, "toxic")
    assert accuracy > 0.9 and accuracy > 1 - rate
    model = toxicity.fitted(docs, labels, ~held_out(5, 0))
    hidden = ["the 1d10t is in the", "of the i d i o t and that", "this idiiiiot was", "a quiet text of the and", None, ""]
    got = by_id(toxicity.restored(table(spark, hidden), model), "restored")
    assert all("idiot" in got[i][0] for i in range(3)) and got[3][0] == hidden[3] and got[4][0] == got[5][0] == ""
    scores = {r["id"]: r.score for r in toxicity.scored(keyed(table(spark, hidden)), model).collect()}
    assert min(scores[i] for i in range(3)) > max(scores[i] for i in (3, 4, 5))
    bare = toxicity.toxicity_report(table(spark, odd_texts), labels.limit(0), held_out(5, 0)).collect()
    assert len(bare) == len(odd_texts) and all(0 <= r.score <= 1 for r in bare)


def test_toxicity_decodes_every_form_of_the_channel(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs, labels, ~held_out(5, 0))
    forms = {
        "the idio+ is in the": "idiot",
        "the iidiot, and that": "idiot",
        "of the idiott in the": "idiot",
        "that 1 d 1 0 t was the": "idiot",
        "that i  d  i  o  t was": "idiot",
        "an i/d/i/o/t in the": "idiot",
        "the stuupid of the": "stupid",
        "it was the moronn and": "moron",
        "the m 0 r 0 n of it": "moron",
        "this worthle55 of the": "worthles",
    }
    clean = ["the hand and that of the, in.", "a quiet text (of the) and!", "in 1990 the 25 of the 3", "it's a hand, I'm in", "well"]
    texts = [*forms, *clean, "i d", "i o t"]
    got = by_id(toxicity.restored(table(spark, texts), model), "restored")
    assert [w for i, w in enumerate(forms.values()) if w not in got[i][0]] == []
    # A mark behind a word is read as a space.
    assert [got[len(forms) + k][0] for k in range(len(clean))] == [t.replace("!", " ") for t in clean]
    scores = {r["id"]: r.score for r in toxicity.scored(keyed(table(spark, texts)), model).collect()}
    hidden = [i for i, w in enumerate(forms.values()) if w == "idiot"]
    assert min(scores[i] for i in hidden) > max(scores[len(forms) + k] for k in range(len(clean)))


def test_spans_end_with_their_document():
    texts = [b"a", b"b c", b"oo", b"ok", b"k9", b"", b"9", b"x y"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    at = {int(offsets[k]): k for k in range(8) if texts[k]}
    assert [at[a] for a, _ in toxicity.suspicious_spans(data, offsets)] == [2, 4]
    for text in (b"", b"a", b"1", b" ", b"...", b"55", b"\xc3\xa9\xc3\xa9"):
        assert toxicity.suspicious_spans(np.frombuffer(text, np.uint8), np.array([0, len(text)])) == []


def test_sample_takes_one_row_of_each_id(spark):
    docs = table(spark, [f"hot {k % 7}" for k in range(300)] + ["b", None], [5] * 300 + [6, 7])
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (8, 0)], "doc_id long, quality int")
    rows = quality_model.sampled(docs, labels, "quality", F.lit(True), 3).collect()
    assert len(rows) <= 3 and len({r.doc_id for r in rows}) == len(rows)
    every = quality_model.sampled(docs, labels, "quality", F.lit(True), 9).collect()
    assert sorted(r.doc_id for r in every) == [5, 6, 7]
    assert {r.doc_id: r.text for r in every}[7] == ""


def test_empty_tables(spark):
    docs = table(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (
        jaccard_join.component_report(docs),
        jaccard_join.one_per_class(docs),
        substring_dedup.without_repeats(docs),
        quality_rules.kept_documents(docs),
        exact_dedup.deduplicated(docs),
        exact_dedup.first_of_equal(docs),
        mixing.mix_report(docs),
        mixing.mixed_documents(docs),
        bpe.encoded(docs, tokenizer_path()),
        link_trust.judged(spark.createDataFrame([], "page_id long, url string, html string")),
        quality_model.quality_report(docs, labels, held_out(3, 1)),
        toxicity.toxicity_report(docs, labels, held_out(5, 0)),
    ):
        assert frame.count() == 0


def test_missing_and_repeated_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i % 90}" for i in range(100))
    rows = [(None, long, 1), (3, long, 2), (3, long, 3), (3, "other words here", 4), (None, None, 5)]
    docs = spark.createDataFrame([(i, t, "s", n, n, n) for i, t, n in rows], "doc_id long, text string, source string, id long, th long, kept long")
    report = jaccard_join.component_report(docs)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in report.collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3), (3, 3)]
    left = substring_dedup.without_repeats(docs).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in left) == [(-1, 0), (-1, 100), (3, 0), (3, 0), (3, 0)]
    once = exact_dedup.first_of_equal(docs)
    assert once.columns == docs.columns and once.count() == 3
    assert jaccard_join.one_per_class(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert len(quality_rules.judged(docs).collect()) == 5
