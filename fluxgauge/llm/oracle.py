"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from fluxgauge.llm import link_trust
from fluxgauge.llm.quality_rules import STOP_WORDS

ORACLE: dict[str, str] = {}

ORACLE["op5_substring_dedup"] = r"""
WITH docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
wins AS (
    SELECT doc_id, i, word,
           CASE WHEN count(*) OVER ahead = 13 THEN string_agg(word, ' ') OVER ahead END AS g
    FROM flat WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
),
firsts AS (SELECT g, min(doc_id) AS low FROM wins WHERE g IS NOT NULL GROUP BY g HAVING min(doc_id) < max(doc_id)),
marked AS (
    SELECT w.doc_id, w.i, w.word,
           coalesce(max(CASE WHEN f.low < w.doc_id THEN 1 ELSE 0 END)
               OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM wins w LEFT JOIN firsts f ON w.g = f.g
),
left_over AS (
    SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(l.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN left_over l USING (doc_id)
"""

ORACLE["op6_quality_rules"] = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
wins AS (
    SELECT doc_id, i, CASE WHEN count(*) OVER ahead = 3 THEN string_agg(word, ' ') OVER ahead END AS g
    FROM flat WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
),
often AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS again FROM wins),
covered AS (
    SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM often
),
repeats AS (SELECT doc_id, sum(again) AS n FROM covered GROUP BY doc_id),
counts AS (
    SELECT d.doc_id, len(d.w) AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(d.lines) AS n_lines, len(d.lines) - len(list_distinct(d.lines)) AS n_dup_lines,
           len(list_intersect(list_distinct(list_transform(d.w, lambda x: lower(x))), [{", ".join(f"'{w}'" for w in STOP_WORDS)}])) AS n_stop,
           coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM docs d LEFT JOIN repeats r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars BETWEEN 2 * n_words AND 16 * n_words
           AND n_symbols / word_chars <= 0.1 AND n_dup_lines / n_lines <= 0.5 AND n_stop >= 2 AS kept
FROM counts
"""

ORACLE["op7_exact_dedup"] = r"""
WITH docs AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size,
       doc_id = min(doc_id) OVER own AS kept, text_sha256
FROM docs WINDOW own AS (PARTITION BY text_sha256)
"""

ORACLE["op8_mixing"] = r"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight
    FROM docs GROUP BY source
),
levels AS (
    SELECT *, ((sum(source_size) OVER ())::DOUBLE
               - coalesce(sum(3 * source_size::DOUBLE) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
),
plan AS (
    SELECT source, source_size, least(3 * source_size::DOUBLE, weight * max(level) OVER ()) AS target FROM levels
),
ranked AS (
    SELECT d.doc_id, d.size, p.source, p.source_size, p.target,
           floor(CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END)::BIGINT AS whole,
           md5('mix|' || coalesce(d.doc_id, 9223372036854775807) || '|' || d.size)[1:13] AS u
    FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
),
cut AS (
    SELECT *, target - whole * source_size AS budget,
           sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
    FROM ranked
)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN middle <= budget AND whole < 3 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM cut
"""

ORACLE["op10_jaccard_join"] = r"""
WITH RECURSIVE base AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
           WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM base
),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
seen AS (SELECT g FROM flat GROUP BY g HAVING count(*) > 1),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM flat a JOIN seen USING (g) JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
    WHERE a.n * 100 >= 90 * b.n AND b.n * 100 >= 90 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach(x, y) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id
GROUP BY s.doc_id, len(s.s)
"""

# SHA-1 as 40 hex digits, five at a time as four base-32 digits.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(sha1(t), (k // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '')"""

ORACLE["op1_warc_zip"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM p)
SELECT page_id, strlen(t) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM g
"""


def _url_filter_sql() -> str:
    rules = sorted(link_trust.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules))
    kind = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules))
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    host = lambda u: fold(rf"regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)")
    steps = []
    for k in range(1, link_trust.ROUNDS + 1):
        steps.append(
            f"""r{k} AS (SELECT kind, host, sum(rank) AS rank FROM (
                SELECT f.kind, f.dst AS host, f.p * r.rank * {link_trust.DAMPING} AS rank
                FROM flows f JOIN r{k - 1} r ON f.kind = r.kind AND f.src = r.host
                UNION ALL SELECT kind, host, rank * {1 - link_trust.DAMPING} FROM r0) GROUP BY kind, host)"""
        )
    return rf"""
WITH placed AS (
    SELECT page_id, coalesce({host("url")}, '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS html
    FROM pages
),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {kind} END AS ruled FROM placed),
hosts AS (SELECT DISTINCT host FROM ruled WHERE host <> ''),
links AS (
    SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*[\x22'']?([^\x22''\s>]+)', 1)) AS link FROM ruled
),
ends_ AS (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links),
family AS (SELECT a.host AS src, b.host AS dst FROM hosts a JOIN hosts b ON substr(a.host, instr(a.host, '.') + 1) = b.host AND a.host <> b.host),
edges AS (
    SELECT src, dst, count(*) AS w FROM (
        SELECT src, dst FROM ends_ WHERE src <> '' AND dst <> '' AND src <> dst
        UNION ALL SELECT src, dst FROM family UNION ALL SELECT dst, src FROM family) GROUP BY src, dst
),
both_ AS (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
flows AS (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS p FROM both_),
r0 AS (
    SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS rank
    FROM (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n
          FROM ruled WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL)
),
{", ".join(steps)},
bad AS (
    SELECT host FROM r{link_trust.ROUNDS} GROUP BY host
    HAVING sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) > {link_trust.SHARE} * sum(rank)
)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN bad b ON r.host = b.host
"""


ORACLE["op9_url_filter"] = _url_filter_sql()


def _vector_code_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""far{k} AS (
                SELECT x.vec_id, x.p, c.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d
                FROM cut x JOIN book{k} c USING (p)
            ),
            near{k} AS (SELECT vec_id, p, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM far{k} GROUP BY vec_id, p)"""
        )
        if k < rounds:
            steps.append(
                f"""mean{k} AS (
                    SELECT p, e, list(m ORDER BY i) AS v FROM (
                        SELECT n.p, n.e, i, floor(sum(x.v[i])::DOUBLE / count(*))::BIGINT AS m
                        FROM near{k} n JOIN cut x USING (vec_id, p), LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS i)
                        GROUP BY n.p, n.e, i) GROUP BY p, e
                ),
                book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)"""
            )
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({256} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
cut AS (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) r(p)),
book0 AS (
    SELECT p, e, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)
),
{", ".join(steps)},
coded AS (
    SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id
),
final AS (
    SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256
    FROM (SELECT p, e, array_to_string(v, ',') AS t FROM book{rounds})
)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256
FROM coded c JOIN kept k USING (vec_id), final
"""


ORACLE["op11_vector_code"] = _vector_code_sql()

ORACLE["op12_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM docs),
keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT a.doc_id, a.i, a.line, coalesce(a.doc_id <> f.first, false) AS gone FROM keyed a LEFT JOIN firsts f ON a.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# 1 where the CRC-32 of a decimal number is even: the register, computed bit by bit, is inverted at last.
_CRC_EVEN = """list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) & 1"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _tree_sql(name: str, leaves: str, arity: int = 3) -> str:
    return f"""{name}(level, tree, idx, n, h) AS (
    SELECT 0::BIGINT, tree, idx::BIGINT, n::BIGINT, h FROM {leaves}
    UNION ALL
    SELECT level + 1, tree, idx // {arity}, (n + {arity - 1}) // {arity}, sha256(string_agg(h, '' ORDER BY idx))
    FROM {name} WHERE n > 1 GROUP BY level, tree, idx // {arity}, n
)"""


def _proof_sql(name: str, tree: str, leaves: str, start: str, arity: int = 3) -> str:
    """Per leaf, level by level: the siblings so far and the digest folded so far."""
    own = f"(f.idx // {arity} = s.idx // {arity})"
    return f"""{name}(level, tree, leaf, idx, n, proof, folded) AS (
    SELECT 0::BIGINT, tree, idx::BIGINT, idx::BIGINT, n::BIGINT, ''::VARCHAR, {start} FROM {leaves}
    UNION ALL
    SELECT f.level + 1, f.tree, f.leaf, f.idx // {arity}, (f.n + {arity - 1}) // {arity},
           f.proof || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (WHERE s.idx <> f.idx), ''),
           sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.folded ELSE s.h END, '' ORDER BY s.idx))
    FROM {name} f JOIN {tree} s ON f.tree = s.tree AND f.level = s.level AND {own}
    WHERE f.n > 1 GROUP BY f.level, f.tree, f.leaf, f.idx, f.n, f.proof, f.folded
)"""


ORACLE["op13_merkle"] = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, {_leaf_sql("text")} AS h,
           CASE WHEN {_CRC_EVEN} = 1 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS later
    FROM documents
),
leaves AS (
    SELECT doc_id, h, later, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
    FROM docs
),
{_tree_sql("nodes", "leaves")},
subroots AS (SELECT 0::BIGINT AS tree, tree AS idx, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
{_tree_sql("upper_nodes", "subroots")},
{_proof_sql("proofs", "nodes", "leaves", "later")},
{_proof_sql("upper_proofs", "upper_nodes", "subroots", "h")},
own AS (SELECT tree, leaf, proof, folded FROM proofs WHERE n = 1),
above AS (SELECT leaf AS tree, proof FROM upper_proofs WHERE n = 1),
heads AS (
    SELECT 0::BIGINT AS tree, o.tree AS idx, o.leaf, s.n, o.folded AS h FROM own o JOIN subroots s ON s.idx = o.tree
),
ends_(level, tree, leaf, idx, n, folded) AS (
    SELECT 0::BIGINT, idx, leaf, idx, n, h FROM heads
    UNION ALL
    SELECT f.level + 1, f.tree, f.leaf, f.idx // 3, (f.n + 2) // 3,
           sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.folded ELSE s.h END, '' ORDER BY s.idx))
    FROM ends_ f JOIN upper_nodes s ON f.level = s.level AND f.idx // 3 = s.idx // 3
    WHERE f.n > 1 GROUP BY f.level, f.tree, f.leaf, f.idx, f.n, f.folded
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(o.proof || a.proof) AS proof_sha256,
       e.folded AS folded_root, e.folded = r.h AS verified
FROM leaves l
JOIN own o ON o.tree = l.tree AND o.leaf = l.idx
JOIN above a ON a.tree = l.tree
JOIN subroots s ON s.idx = l.tree
JOIN ends_ e ON e.tree = l.tree AND e.leaf = l.idx AND e.n = 1
JOIN (SELECT h FROM upper_nodes WHERE n = 1) r ON true
"""
