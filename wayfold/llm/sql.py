"""SQL for the results that SQL can express (DuckDB dialect), written from the contracts and not from the operators."""

OP3 = """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93e0),
reach AS (
  SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN link l ON l.u = r.w),
comp AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.u = v.vec_id LEFT JOIN degree d ON d.u = v.vec_id"""

OP7 = r"""WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
place AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM place),
seen AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM win),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM seen, range(13) r(k) WHERE first_doc < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS s FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP6 = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM t WHERE len(h) >= 200)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win),
again AS (
  SELECT doc_id, i, CASE WHEN i <= max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
  FROM ranked WHERE r > 1),
runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM again),
span AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
part AS (
  SELECT doc_id, a, substr(h, 2 * before + 1, 2 * (a - before)) AS s FROM edge JOIN t USING (doc_id) UNION ALL
  SELECT doc_id, 1e18::BIGINT, substr(h, 2 * max(b) + 1) FROM span JOIN t USING (doc_id) GROUP BY doc_id, h),
kept AS (SELECT doc_id, string_agg(s, '' ORDER BY a) AS s FROM part GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.s, h))) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: CRC-32 of the texts `s` of a table `keyed (s)`, as `crc (s, v)`: the table of the 256 steps by its rule, then byte by byte.
_CRC = """bits(b, k, v) AS (
  SELECT b, 0, CAST(b AS BIGINT) FROM range(256) t(b) UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
step AS (SELECT b, v FROM bits WHERE k = 8),
walk(s, i, c) AS (
  SELECT DISTINCT s, 1, 4294967295::BIGINT FROM keyed WHERE s IS NOT NULL UNION ALL
  SELECT s, i + 1, xor(c >> 8, v) FROM walk JOIN step ON b = xor(c, CAST(ascii(substr(s, i, 1)) AS BIGINT)) & 255 WHERE i <= length(s)),
crc AS (SELECT s, xor(c, 4294967295::BIGINT) AS v FROM walk WHERE i = length(s) + 1)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


OP11 = f"""WITH RECURSIVE keyed AS (SELECT CAST(doc_id AS VARCHAR) AS s FROM documents), {_CRC},
leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf('n_chars')} AS h, CASE WHEN v % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS t
  FROM documents LEFT JOIN crc ON s = CAST(doc_id AS VARCHAR)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree(g, lev, p, n, h) AS (
  SELECT g, 0, p, n, h FROM placed UNION ALL
  SELECT g, lev + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM tree WHERE n > 1 GROUP BY g, lev, p // 2, n),
subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lev, p, n, h) AS (
  SELECT 0, p, n, h FROM subs UNION ALL
  SELECT lev + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY lev, p // 2, n),
flank AS (
  SELECT l.g, l.p, t.lev AS lev, (l.p >> t.lev) & 1 AS odd, coalesce(s.h, '') AS h
  FROM placed l JOIN (SELECT DISTINCT g, lev FROM tree WHERE n > 1) t ON t.g = l.g
  LEFT JOIN tree s ON s.g = l.g AND s.lev = t.lev AND s.p = xor(l.p >> t.lev, 1) UNION ALL
  SELECT l.g, l.p, 1000 + t.lev, (u.p >> t.lev) & 1, coalesce(s.h, '')
  FROM placed l JOIN subs u ON u.g = l.g JOIN (SELECT DISTINCT lev FROM top WHERE n > 1) t ON true
  LEFT JOIN top s ON s.lev = t.lev AND s.p = xor(u.p >> t.lev, 1)),
steps AS (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY lev) AS k, count(*) OVER (PARTITION BY g, p) AS m FROM flank),
up(g, p, k, h) AS (
  SELECT g, p, 1, t FROM placed UNION ALL
  SELECT up.g, up.p, up.k + 1, sha256(CASE WHEN odd = 1 THEN s.h || up.h ELSE up.h || s.h END)
  FROM up JOIN steps s ON s.g = up.g AND s.p = up.p AND s.k = up.k),
proof AS (SELECT g, p, string_agg(h, '' ORDER BY k) AS h, max(m) AS m FROM steps GROUP BY g, p)
SELECT l.doc_id, l.h AS leaf, u.h AS subroot, r.h AS root, sha256(coalesce(f.h, '')) AS proof_sha256, up.h AS folded_root, up.h = r.h AS verified
FROM placed l JOIN subs u ON u.g = l.g JOIN (SELECT h FROM top WHERE n = 1) r ON true
LEFT JOIN proof f ON f.g = l.g AND f.p = l.p JOIN up ON up.g = l.g AND up.p = l.p AND up.k = coalesce(f.m, 0) + 1"""


#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. `hop`: insertions before a row.
OP12 = rf"""WITH RECURSIVE keyed AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations), {_CRC},
hop(p, mid, cost, ext, made) AS (VALUES
  (0, 0, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, '', ''), (1, 2, 5, 'I', chr(10) || 'user:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', chr(10) || 'user:')),
raw AS (
  SELECT coalesce('1' || CAST(conv_id AS VARCHAR), '0') AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, v % 20 AS m
  FROM conversations JOIN crc ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
harmed AS (
  SELECT g, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw JOIN range(2) c(n) ON n < CASE WHEN m = 0 THEN 0 WHEN m = 3 THEN 2 ELSE 1 END),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM harmed),
judged AS (
  SELECT *, regexp_extract(text, '([^ \t-\r])[ \t-\r]*$', 1) AS tail, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
    left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair FROM placed),
kinds AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault FROM judged),
rec(g, i, q, best) AS (
  SELECT DISTINCT g, 1::BIGINT, 0, {{'cost': 0, 'audit': '', 'made': ''}} FROM raw UNION ALL
  SELECT r.g, r.i + 1, o.q, min({{'cost': r.best.cost + h.cost + o.cost, 'audit': r.best.audit || h.ext || o.letter,
    'made': r.best.made || h.made || CASE o.letter WHEN 'K' THEN chr(10) || k.role || ':' || k.text
      WHEN 'R' THEN chr(10) || CASE WHEN o.q = 3 THEN 'assistant:' ELSE 'user:' END || k.text ELSE '' END}})
  FROM rec r JOIN kinds k ON k.g = r.g AND k.i = r.i JOIN hop h ON h.p = r.q,
  LATERAL (
    SELECT 'D' AS letter, h.mid AS q, 2 AS cost UNION ALL
    SELECT 'R', CASE WHEN h.mid = 2 THEN 3 ELSE 2 END, 1 + CASE WHEN k.fault = '' THEN 0 ELSE 5 END WHERE k.fault IN ('', 'truncated') UNION ALL
    SELECT 'K', CASE k.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN k.fault = '' THEN 0 ELSE 5 END
    WHERE k.fault IN ('', 'truncated') AND (k.c = 's' AND h.mid = 0 OR k.c = 'u' AND h.mid <> 2 OR k.c = 'a' AND h.mid = 2)) o
  GROUP BY r.g, r.i, o.q),
counts AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM kinds GROUP BY g),
ended AS (
  SELECT r.g, min({{'cost': r.best.cost + h.cost, 'audit': r.best.audit || h.ext, 'made': r.best.made || h.made}}) AS best
  FROM rec r LEFT JOIN counts c ON c.g = r.g JOIN hop h ON h.p = r.q WHERE r.i = coalesce(c.n, 0) + 1 AND h.mid IN (0, 3) GROUP BY r.g)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.made, 2)) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM raw) o JOIN ended USING (g) LEFT JOIN counts USING (g)"""


#: The exact answer. The operator finds all of it while a table is one list; with more lists its recall is in the README.
OP13 = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
good AS (
  SELECT *, list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y) AS ee FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda x, y: x + y) / sqrt(q.ee * c.ee) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 5"""
