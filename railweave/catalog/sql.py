"""SQL fragments shared by the oracle texts (DuckDB dialect).

RE2 knows ASCII word boundaries only.  ``ascii_words`` maps the accented letters that
patterns mention to digits and every other non-ASCII letter to 0, so that boundaries and
letters agree with the Unicode patterns; ``guarded`` wraps accented letters instead,
where the text has to survive.
"""

from __future__ import annotations

from railweave.functions import wordlists as W

OTHER_LETTER = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]"
MARK = "zZ9"
BLANKS = r"E' \n\t\r'"
_DIGITS = {"à": "1", "î": "2", "í": "3", "ó": "4", "á": "5", "ö": "6", "ê": "7"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def ascii_words(text: str) -> str:
    source = "0123456789_" + "".join(c + c.upper() for c in _DIGITS)
    target = "00000000000" + "".join(d + d for d in _DIGITS.values())
    return (f"regexp_replace(translate({text}, '{source}', '{target}'), '{OTHER_LETTER}', '0', 'g')")


def guarded(text: str) -> str:
    return f"regexp_replace({text}, '({OTHER_LETTER})', '{MARK}\\1{MARK}', 'g')"


def unguarded(text: str) -> str:
    return f"replace({text}, '{MARK}', '')"


def phrase_pattern(phrases) -> str:
    """SQL literal of an alternation over ``ascii_words`` text."""
    pattern = "|".join(phrases)
    for letter, digit in _DIGITS.items():
        pattern = pattern.replace(letter, digit)
    return quoted(f"(?i)\\b(?:{pattern})\\b")


def strip(text: str) -> str:
    return f"trim({text}, {BLANKS})"


def clean_mention(text: str) -> str:
    t = f"regexp_replace({strip(text)}, {quoted(W.MENTION_TAIL_PUNCTUATION)}, '')"
    t = f"regexp_replace({t}, {quoted('(?i)' + W.MENTION_ARTICLE)}, '')"
    return strip(f"regexp_replace({t}, {quoted('(?i)' + W.MENTION_TAIL_WORDS)}, '')")


def squeeze(text: str) -> str:
    return strip(f"regexp_replace({text}, '\\s+', ' ', 'g')")


def clean_artifacts(text: str) -> str:
    import re

    markers = "|".join(re.escape(m) for m in W.ARTIFACT_MARKERS)
    inner = f"regexp_replace({text}, {quoted(markers)}, ' ', 'g')"
    return squeeze(f"regexp_replace({inner}, {quoted('|'.join(W.ARTIFACT_PATTERNS))}, ' ', 'g')")


def clean_text(text: str) -> str:
    """Default clean pipeline."""
    dashes = f"translate(nfc_normalize({text}), {quoted(W.DASHES)}, '{'-' * len(W.DASHES)}')"
    apos = f"translate({dashes}, {quoted(W.APOSTROPHES)}, {quoted(chr(39) * len(W.APOSTROPHES))})"
    return strip(f"regexp_replace({apos}, '[\\t\\n\\r\\f\\v ]+', ' ', 'g')")


def fold(text: str) -> str:
    t = f"strip_accents({text})"
    for a, b in (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


def normalize_name(text: str) -> str:
    t = f"translate(lower({fold(text)}), {quoted('-' + chr(39) + '`')}, '   ')"
    return squeeze(f"regexp_replace({t}, '[^\\w\\s]', '', 'g')")


def city_name(text: str) -> str:
    for suffix in W.CITY_SUFFIXES:
        text = f"regexp_replace({text}, {quoted('(?i)' + suffix)}, '')"
    return strip(text)


def language_ctes(source: str, key: str = "doc_id", text: str = "text") -> str:
    """CTE 'lang_pred'(key, label, conf) over a source table."""
    words = ascii_words(text)
    return f"""
lang_words AS (SELECT {key} AS k, {text} AS t, {words} AS a FROM {source}),
lang_counts AS (SELECT k, t, a,
    len(regexp_extract_all(a, {phrase_pattern(W.FRENCH_PHRASES)})) AS f,
    len(regexp_extract_all(a, {phrase_pattern(W.ENGLISH_PHRASES)})) AS e,
    len(regexp_extract_all(a, {phrase_pattern(W.OTHER_PHRASES)})) AS o FROM lang_words),
lang_pred AS (SELECT k AS {key},
    CASE WHEN length({strip('t')}) < 2 THEN 'UNKNOWN' WHEN o > 0 AND o >= greatest(f, e) THEN 'UNKNOWN'
         WHEN f + e + o = 0 THEN 'UNKNOWN' WHEN f > e THEN 'FRENCH' WHEN e > f THEN 'ENGLISH'
         WHEN f > 0 AND regexp_matches(a, {phrase_pattern(W.FRENCH_TIE_WORDS)}) THEN 'FRENCH'
         ELSE 'UNKNOWN' END AS label,
    CASE WHEN length({strip('t')}) < 2 THEN 0.5 WHEN o > 0 AND o >= greatest(f, e) THEN 0.7
         WHEN f + e + o = 0 THEN 0.4
         WHEN f > e THEN least(0.95, 0.5 + f / (f + e + o + 1) * 0.5)
         WHEN e > f THEN least(0.95, 0.5 + e / (f + e + o + 1) * 0.5)
         WHEN f > 0 AND regexp_matches(a, {phrase_pattern(W.FRENCH_TIE_WORDS)}) THEN 0.6
         WHEN f > 0 THEN 0.5 ELSE 0.4 END::DOUBLE AS conf FROM lang_counts)"""


def intent_ctes(source: str, key: str = "doc_id", text: str = "text") -> str:
    """CTE 'intent_pred'(key, label, conf)."""
    return f"""
intent_words AS (SELECT {key} AS k, {strip(f'lower({text})')} AS t FROM {source}),
intent_flags AS (SELECT k, length(t) AS n, len(regexp_extract_all(t, '\\S+')) AS w,
    regexp_matches({ascii_words('t')}, {phrase_pattern(W.TRIP_PHRASES)}) AS hit FROM intent_words),
intent_pred AS (SELECT k AS {key},
    CASE WHEN n < 3 THEN 'UNKNOWN' WHEN hit THEN 'TRIP' WHEN w BETWEEN 2 AND 4 THEN 'TRIP'
         ELSE 'NOT_TRIP' END AS label,
    CASE WHEN n < 3 THEN 0.8 WHEN hit THEN 0.8 WHEN w BETWEEN 2 AND 4 THEN 0.5
         ELSE 0.6 END::DOUBLE AS conf FROM intent_flags)"""


def slot_ctes(source: str, key: str = "doc_id", text: str = "text") -> str:
    """CTE 'slot_pred'(key, departure, destination, intermediate list)."""
    steps, previous = "", "slot0"
    for n, (pattern, dep, dest) in enumerate((
            (W.DE_A, 1, 2), (W.A_DEPUIS, 2, 1), (W.VERS, 1, 2), (W.FROM_TO, 1, 2), (W.X_TO_Y, 1, 2)), 1):
        p = quoted("(?i)" + pattern)
        fires = (f"(coalesce(dep, '') = '' OR coalesce(dest, '') = '') AND regexp_matches(t, {p})")
        steps += f"""
slot{n} AS (SELECT k, t,
    CASE WHEN {fires} THEN {clean_mention(f'regexp_extract(t, {p}, {dep})')} ELSE dep END AS dep,
    CASE WHEN {fires} THEN {clean_mention(f'regexp_extract(t, {p}, {dest})')} ELSE dest END AS dest
    FROM {previous}),"""
        previous = f"slot{n}"
    three = quoted("(?i)" + W.THREE_STOPS)
    delimiters = quoted("(?i)" + W.PART_DELIMITERS)
    prefix = quoted("(?i)" + W.PART_PREFIX)
    part = f"regexp_replace({strip(unguarded('x'))}, {prefix}, '')"
    fr, en = quoted("(?i)" + W.VIA_FR), quoted("(?i)" + W.VIA_EN)
    return f"""
slot0 AS (SELECT {key} AS k, regexp_replace({text}, '\\n\\z', '') AS t, NULL::VARCHAR AS dep,
    NULL::VARCHAR AS dest FROM {source}),{steps}
slot_parts AS (SELECT k, list_transform(list_filter(list_transform(
        string_split_regex({guarded('t')}, {delimiters}), lambda x: {part}),
        lambda p: length(p) > 1 AND len(list_filter(regexp_extract_all(lower(p), '\\S+'),
            lambda w: NOT list_contains({listed(W.PART_STOPWORDS)}, w))) > 0),
        lambda p: {strip('p')}) AS parts
    FROM {previous} WHERE coalesce(dep, '') = '' OR coalesce(dest, '') = ''),
slot_found AS (SELECT s.k, s.t, CASE WHEN len(parts) >= 2 THEN parts[1] ELSE dep END AS dep,
    CASE WHEN len(parts) >= 2 THEN parts[-1] ELSE dest END AS dest,
    CASE WHEN len(parts) > 2 THEN parts[2:len(parts) - 1] ELSE []::VARCHAR[] END AS mid
    FROM {previous} s LEFT JOIN slot_parts p ON s.k = p.k),
slot_via AS (SELECT *, CASE WHEN regexp_matches(t, {fr}) THEN {clean_mention(f'regexp_extract(t, {fr}, 1)')}
    WHEN regexp_matches(t, {en}) THEN {clean_mention(f'regexp_extract(t, {en}, 1)')} END AS via FROM slot_found),
slot_pred AS (SELECT k AS {key},
    CASE WHEN regexp_matches(t, {three}) THEN {clean_mention(f'regexp_extract(t, {three}, 1)')} ELSE dep END AS departure,
    CASE WHEN regexp_matches(t, {three}) THEN {clean_mention(f'regexp_extract(t, {three}, 3)')} ELSE dest END AS destination,
    CASE WHEN regexp_matches(t, {three}) THEN list_filter([{clean_mention(f'regexp_extract(t, {three}, 2)')}], lambda v: v <> '')
         WHEN len(mid) > 0 THEN mid
         WHEN via <> '' AND via IS DISTINCT FROM dep AND via IS DISTINCT FROM dest THEN [via]
         ELSE []::VARCHAR[] END AS intermediate FROM slot_via)"""


def hash_int(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([quoted(str(seed)), *[f"({p})::VARCHAR" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def uniform(seed: int, *parts: str) -> str:
    return f"({hash_int(seed, *parts)} / 4294967296.0)"


def hash_key(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([quoted(str(seed)), *[f"({p})::VARCHAR" for p in parts]])
    return f"md5({text})"


def distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")


def sample_ctes() -> str:
    """CTE 'samples': the labelled sentences of ``roles.samples``."""
    from railweave.operators import training as K

    def floor(n: str, share: float) -> str:
        return f"floor({n} * {share}::DOUBLE)::BIGINT"

    def rest(n: str, shares) -> str:
        return f"{n} - " + " - ".join(floor(n, s) for _, s in shares if s is not None)

    cells = []
    for lang, share in K.TRIP_SHARES:
        n = f"({floor('trip', share) if share is not None else rest('trip', K.TRIP_SHARES)})"
        if lang == "MIXED":
            cells.append(("TRIP", lang, "regular", n))
            continue
        stops = floor(n, 0.15)
        cut = floor(n, K.TRUNCATED_SHARE) if lang == "FRENCH" else "0"
        small = floor(n, K.MINIMAL_SHARE) if lang == "FRENCH" else "0"
        cells += [("TRIP", lang, "regular", f"{n} - {stops} - {cut} - {small}"),
                  ("TRIP", lang, "minimal", small), ("TRIP", lang, "intermediate", stops),
                  ("TRIP", lang, "truncated", cut)]
    for lang, share in K.NOT_TRIP_SHARES:
        n = floor("other", share) if share is not None else rest("other", K.NOT_TRIP_SHARES)
        cells.append(("NOT_TRIP", lang, "regular", n))
    cells.append(("UNKNOWN", "UNKNOWN", "regular", "total - trip - other"))
    rows = ", ".join(
        f"{{'c': {i}, 'intent': '{a}', 'language': '{b}', 'kind': '{k}', 'n': ({n})::BIGINT}}"
        for i, (a, b, k, n) in enumerate(cells))
    templates = ", ".join(f"({', '.join(map(quoted, t))})" for t in K.TEMPLATES)

    def draw(step: str) -> str:
        return hash_int(42, quoted(step), "sentence_id")

    def used(slot: str) -> str:
        return (f"CASE WHEN intent = 'TRIP' AND contains(template, '{{{slot}}}') "
                f"THEN coalesce({slot}.place, '') ELSE '' END")

    return f"""
quota0 AS (SELECT total, {floor('total', 0.74)} AS trip, {floor('total', 0.25)} AS other
  FROM (SELECT count(*) AS total FROM orders)),
quota1 AS (SELECT unnest([{rows}]) AS r FROM quota0),
quota AS (SELECT r.intent, r.language, r.kind, r.n, sum(r.n) OVER (ORDER BY r.c) - r.n AS start_no,
  sum(r.n) OVER (ORDER BY r.c) AS end_no FROM quota1),
choices AS (SELECT intent, language, kind, list(template ORDER BY template) AS ts
  FROM (VALUES {templates}) t(intent, language, kind, template) GROUP BY 1, 2, 3),
pool AS (SELECT place, row_number() OVER (ORDER BY {hash_key(0, 'place')}) - 1 AS idx, count(*) OVER () AS n
  FROM (SELECT DISTINCT p_name AS place FROM part)),
asked AS (SELECT 'BASE' || lpad((o_orderkey + 1)::VARCHAR, greatest(6, length((o_orderkey + 1)::VARCHAR))::INT, '0') AS sentence_id,
  o_orderkey AS row_no FROM orders),
draw0 AS (SELECT a.sentence_id, a.row_no, q.intent, q.language, q.kind, (SELECT max(n) FROM pool) AS n, ts
  FROM asked a JOIN quota q ON a.row_no >= q.start_no AND a.row_no < q.end_no
  JOIN choices c ON c.intent = q.intent AND c.language = q.language AND c.kind = q.kind),
draw1 AS (SELECT *, ts[1 + {draw('template')} % len(ts)] AS template, {draw('dep')} % n AS i_dep FROM draw0),
draw2 AS (SELECT *, (i_dep + 1 + {draw('via')} % (n - 1)) % n AS i_via, {draw('dest')} % (n - 2) AS d0 FROM draw1),
draw3 AS (SELECT *, d0 + CASE WHEN d0 >= least(i_dep, i_via) THEN 1 ELSE 0 END AS d1 FROM draw2),
draw4 AS (SELECT *, d1 + CASE WHEN d1 >= greatest(i_dep, i_via) THEN 1 ELSE 0 END AS i_dest FROM draw3),
samples AS (SELECT sentence_id, row_no, intent, language, kind,
  replace(replace(replace(template, '{{dep}}', dep.place), '{{via}}', via.place), '{{dest}}', dest.place) AS sentence,
  {used('dep')} AS departure, {used('dest')} AS destination, {used('via')} AS intermediate
  FROM draw4 LEFT JOIN pool dep ON dep.idx = i_dep LEFT JOIN pool via ON via.idx = i_via LEFT JOIN pool dest ON dest.idx = i_dest)"""


def class_metrics(source: str, keys: str = "") -> str:
    """CTE 'metrics'(keys, class, tp, fp, fn, tn, precision, recall, f1, support) over
    ``source`` (keys, class, t, p) where t and p say whether truth and prediction are the class."""
    k = f"{keys}, " if keys else ""
    return f"""
counts AS (SELECT {k}class, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp,
  count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM {source} GROUP BY {k}class),
ratios AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS recall FROM counts),
metrics AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END::DOUBLE AS f1,
  tp + fn AS support FROM ratios)"""
