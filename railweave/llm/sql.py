"""SQL twins of the operators' queries, for DuckDB."""

from __future__ import annotations

from railweave.llm import license_scan

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Number of the hash range never matters to the result, so the twins sort each source as a whole.
ORACLES: dict[str, str] = {}

ORACLES["op10_mix"] = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS rank, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, sum(cap) OVER w - cap AS before,
        sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM r WINDOW w AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, cap::HUGEINT * rest <= weight * (total - before)::HUGEINT AS filled FROM f),
h AS (SELECT *, max(CASE WHEN NOT filled THEN (total - before)::DOUBLE / rest::DOUBLE END) OVER () AS level FROM g),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE weight * level END AS target FROM h),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('23|' || coalesce(doc_id::VARCHAR, '') || '|' || digest), doc_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""

ORACLES["op6_host_rules"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid, {WORDS} AS w FROM documents),
m AS (SELECT rid, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
c AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
x AS (SELECT m.rid, doc_id, source, n_words, word_chars, n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM m LEFT JOIN rep ON m.rid = rep.rid),
y AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM x),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM y GROUP BY source),
p AS (SELECT avg(k / n) AS mean, var_pop(k / n) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 0 THEN greatest(mean * (1 - mean) / greatest(spread, 1e-12) - 1, 0) ELSE 100 END AS strength FROM p),
v AS (SELECT source, (k + mean * strength) / (n + strength) <= 0.75 AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM y JOIN v ON y.source IS NOT DISTINCT FROM v.source
"""

ORACLES["op9_substrings"] = rf"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS rid, {WORDS} AS w FROM documents),
x AS (SELECT rid, i, array_to_string(w[i:i + 19], ' ') AS seq FROM (SELECT rid, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT rid, i FROM x QUALIFY row_number() OVER (PARTITION BY seq ORDER BY rid, i) > 1),
c AS (SELECT DISTINCT rid, i + o AS i FROM r, (SELECT unnest(range(20)) AS o)),
k AS (SELECT d.rid, u.i, w[u.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) u),
s AS (SELECT k.rid, count(c.i) AS n_removed, string_agg(k.word, ' ' ORDER BY k.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM k LEFT JOIN c ON k.rid = c.rid AND k.i = c.i GROUP BY k.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.rid = s.rid
"""

ORACLES["op4_odd_sketch"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT s.b, r.root FROM r JOIN s ON r.id = s.a WHERE r.root < s.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = d.doc_id
"""

#: Bitwise CRC-32, eight steps per byte through a table that SQL builds.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS v FROM range(256) r(i)))"""

ORACLES["op1_interleave"] = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, source, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size FROM documents),
c AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1),
        lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda a, b: xor(a // 256, crc.steps[xor(a, b) % 256 + 1])), 4294967295::BIGINT) AS text_crc32 FROM d, crc),
r AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY source) AS n FROM c
      WINDOW w AS (PARTITION BY source ORDER BY md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || text_crc32 || '|' || size), doc_id NULLS FIRST, text_crc32, size)),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1) / (2 * n), source NULLS FIRST, rank) - 1 AS pos, count(*) OVER () AS total FROM r),
q AS (SELECT *, pos * 8 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (pos - (shard * total + 7) // 8)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM q
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_spelling"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n FROM o WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT *, hex(encode(id || ':' || run)) AS bytes FROM c),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(bytes) // 2),
        lambda i: ('0x' || substr(bytes, (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda a, z: xor(a // 256, crc.steps[xor(a, z) % 256 + 1])), 4294967295::BIGINT) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run) + 2)::BIGINT:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT x.word AS a, y.word AS b, y.n FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
m AS (SELECT a AS word, count(*) AS n_near, max(n) AS top FROM p GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(m.n_near, 0)::BIGINT AS n_near, CASE WHEN m.top >= 5 * v.n THEN m.top END AS form_n FROM v LEFT JOIN m ON v.word = m.word),
g AS (SELECT f.word, min(encode(p.b)) AS first FROM f JOIN p ON p.a = f.word AND p.n = f.form_n GROUP BY f.word),
e AS (SELECT f.*, decode(g.first) AS form FROM f LEFT JOIN g ON f.word = g.word),
r AS (SELECT word, word AS root FROM e UNION ALL SELECT r.word, e.form FROM r JOIN e ON r.root = e.word WHERE e.form IS NOT NULL)
SELECT e.word, e.form, r.root, e.n, e.n_near, e.form_n::BIGINT AS form_n
FROM e JOIN r ON r.word = e.word JOIN e AS last ON last.word = r.root AND last.form IS NULL
"""

ORACLES["op12_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, len(w)::BIGINT AS n, [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS k FROM d),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 90 THEN 'plain'
             WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
q AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM q
"""

_TEMPLATES = ", ".join(f"({i}, '{t}', '{label}', {exact})" for i, (t, label, exact) in enumerate(
    [(*p, True) for p in license_scan.PHRASES] + [(*n, False) for n in license_scan.NOTICES]))
_PARTS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op13_licenses"] = rf"""
WITH given AS (SELECT * FROM (VALUES {_TEMPLATES}) z(template, text, label, exact)),
t AS (SELECT template, label, exact, {_PARTS} AS w FROM given),
tg AS (SELECT template, label, exact, len(w) AS size, j - 1 AS j, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] AS gram
       FROM (SELECT *, unnest(range(1, len(w) - 1)) AS j FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_PARTS} AS w FROM documents),
g AS (SELECT rid, i - 1 AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
m AS (SELECT g.rid, tg.*, g.i FROM g JOIN tg ON g.gram = tg.gram),
base AS (SELECT rid, label, i - j AS start FROM m WHERE exact GROUP BY rid, template, label, size, i - j HAVING count(*) = size - 2),
s AS (SELECT *, i - j AS diagonal FROM m WHERE NOT exact),
u AS (SELECT DISTINCT rid, template, diagonal FROM s),
b AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > 4, true)::INT AS begins FROM u WINDOW w AS (PARTITION BY rid, template ORDER BY diagonal)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM b),
k AS (SELECT DISTINCT s.rid, s.template, s.label, s.size, n.span, s.j + o AS place FROM s
      JOIN n ON n.rid = s.rid AND n.template = s.template AND n.diagonal = s.diagonal, (VALUES (0), (1), (2)) x(o)),
c AS (SELECT rid, label, count(*) / size AS share FROM k GROUP BY rid, template, label, size, span),
a AS (SELECT rid, label, true AS base, start, 1.0::DOUBLE AS share FROM base UNION ALL SELECT rid, label, false, NULL, share FROM c),
r AS (SELECT rid, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, max(share) AS score,
        coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base OR share >= 0.6))), ','), '') AS labels FROM a GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r ON d.rid = r.rid
"""
