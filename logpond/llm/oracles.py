"""DuckDB SQL of the operators that SQL can express."""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP7 = f"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
fits AS (SELECT *, ('.' || host) AS h, count(*) OVER (PARTITION BY host, path) AS pages FROM b),
r AS (SELECT *, CASE
        WHEN h LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN h LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN h LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN h LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM fits)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
            ELSE CASE WHEN regexp_matches(h, '[.](spam-farm|free-bets)[.]example[.](com|net|org)$')
                        OR (host <> '' AND pages >= 2)
                 THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{_WORD}+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
win AS (SELECT k, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g
        FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c >= 2),
pos AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY k),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(pos.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up,
             length(regexp_replace(t, '[^a-z]+', '', 'g')) AS lo
      FROM w LEFT JOIN pos USING (k)),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 8 ELSE 0 END
        + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 16 ELSE 0 END
        + CASE WHEN up + lo >= 40 AND 10 * up > 7 * (up + lo) THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ITEM_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_ITEM_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
       FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS s FROM d) CROSS JOIN lens WHERE s + n - 1 <= len(w)),
hit AS (SELECT k, s, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT k, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
       FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN it USING (k)
"""

# base32 of a SHA-1: every five hex digits (20 bits) are four letters
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v{i} >> {s}) & 31 AS INTEGER), 1)"
    for i in range(8) for s in (15, 10, 5, 0))

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
v AS (SELECT page_id, strlen(t) AS n, {', '.join(f"CAST('0x' || substr(x, {1 + 5 * i}, 5) AS BIGINT) AS v{i}" for i in range(8))} FROM p),
d AS (SELECT page_id, n, {_B32} AS digest FROM v),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS low FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to FROM f
"""

OP5 = rf"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
win AS (SELECT k, s, md5(array_to_string(w[s : s + 34], ' ')) AS g
        FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS s FROM w WHERE len(w) >= 35)),
rep AS (SELECT k, s FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT k, unnest(range(s, s + 35)) AS p FROM rep),
g AS (SELECT k, list(p) AS ps, count(*) AS n FROM gone GROUP BY k),
kept AS (SELECT w.k, string_agg(x, ' ' ORDER BY p) AS t
         FROM (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w WHERE len(w) > 0) w
         ANTI JOIN gone ON gone.k = w.k AND gone.p = w.p GROUP BY w.k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (k) LEFT JOIN kept USING (k)
"""

# crc32 of a decimal number's digits, bit by bit
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
  list_transform(range(1, length(c) + 1), lambda i: ascii(substr(c, i, 1))::BIGINT)),
  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP11 = f"""
WITH t AS (SELECT conv_id AS v, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT v, CAST(v AS VARCHAR) AS c FROM t),
h AS (SELECT v, v - v % 100 AS base, {_CRC} % 6 AS h FROM ids),
r AS (SELECT h.v, t.d, t.role, t.text FROM h JOIN t ON t.v = h.base WHERE t.d <= h.h
      UNION ALL
      SELECT h.v, t.d, t.role, t.text FROM h JOIN t ON t.v = h.v WHERE t.d > h.h),
p AS (SELECT v, row_number() OVER (PARTITION BY v ORDER BY d) AS d, role, text FROM r),
g AS (SELECT v, list(md5(strlen(role) || ':' || role || text) ORDER BY d) AS l, list(length(text) ORDER BY d) AS chars FROM p GROUP BY v),
a AS (SELECT h.v, coalesce(l, []) AS l, coalesce(chars, []) AS chars FROM h LEFT JOIN g ON g.v = h.v),
m AS (SELECT v, d, md5(array_to_string(l[1:d], '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(l[1:d - 1], '')) END AS parent,
             coalesce(chars[d], 0) AS chars, d = len(l) AS last
      FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM a)),
n AS (SELECT node, min(d) AS depth, min(v) AS v, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own,
             sha256(coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FILTER (WHERE last), '')) AS ends
      FROM m GROUP BY node),
k AS (SELECT parent, count(*) AS c FROM n WHERE parent IS NOT NULL GROUP BY parent),
x AS (SELECT n.*, coalesce(k.c, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
s AS (SELECT m.node, sum(x.own) AS saved, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS leaves
      FROM x JOIN m ON m.v = x.v AND m.d <= x.depth GROUP BY m.node)
SELECT CAST(x.v AS BIGINT) AS conv_id, CAST(x.depth AS BIGINT) AS depth, CAST(q.v AS BIGINT) AS parent_conv_id,
       CAST(x.n_convs AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN s ON s.node = x.node LEFT JOIN n q ON q.node = x.parent
"""

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(w) < 50 AS INTEGER) AS a, CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER) AS b,
             CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INTEGER) AS c,
             CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) AS d, CAST(coalesce(w.doc_id > low, false) AS INTEGER) AS e,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM f GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM one p, one q, one r, one s, one t
      WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
st AS (SELECT o, step, substr(o, step, 1) AS x, list_sum(list_transform(range(1, step),
              lambda i: 1 << (ascii(substr(o, i, 1)) - 65))) AS before FROM (SELECT o, unnest(range(1, 6)) AS step FROM o)),
z AS (SELECT o, step, x, CAST(coalesce(before, 0) AS INTEGER) AS before, 1 << (ascii(x) - 65) AS own FROM st),
r AS (SELECT part, o, step, x,
        sum(CASE WHEN fails & (before + own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN fails & before = 0 AND fails & own <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails & before <> 0 AND fails & own <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails & before = 0 AND fails & own <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN fails & before = 0 AND fails & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, z GROUP BY part, o, step, x)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
