"""SQL twins of the noise: the same draws, one CTE per rule or step (K10, K10a-d, K11)."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from railweave.catalog import sql as S
from railweave.functions import noise_tables as N

KEY = "sentence_id"
WORDS = "regexp_extract_all(t, '\\S+')"


def drawn(*step: str | int) -> str:
    return S.hash_int(42, KEY, *map(_part, step))


def chance(*step: str | int) -> str:
    return S.uniform(42, KEY, *map(_part, step))


def _part(value: str | int) -> str:
    """Steps are literals; ``:x`` stands for the expression x."""
    value = str(value)
    return value[1:] if value.startswith(":") else S.quoted(value)


def below(n: str, *step: str | int) -> str:
    return f"({drawn(*step)} % greatest({n}, 1))"


def picked(values: Iterable[str], *step: str | int) -> str:
    values = list(values)
    return f"{S.listed(values)}[1 + {drawn(*step)} % {len(values)}]"


def inserted(tokens: str, places: str, word: str) -> str:
    """Text with ``word`` (over i) before each 0-based place of ``tokens``; the length means the end."""
    return (f"array_to_string(flatten(list_transform(range(0, len({tokens}) + 1), lambda i: "
            f"CASE WHEN list_contains({places}, i) THEN [{word}] ELSE []::VARCHAR[] END || "
            f"CASE WHEN i < len({tokens}) THEN [{tokens}[i + 1]] ELSE []::VARCHAR[] END)), ' ')")


def first_replaced(text: str, old: str, new: str, any_case: bool) -> str:
    at = found(text, old, any_case)
    return f"substr({text}, 1, {at} - 1) || {new} || substr({text}, {at} + {len(old)})"


def found(text: str, old: str, any_case: bool) -> str:
    return f"instr(lower({text}), {S.quoted(old.lower())})" if any_case else f"instr({text}, {S.quoted(old)})"


class Chain:
    """CTEs that change the column t one after the other, where a step's gate is open."""

    def __init__(self, source: str, prefix: str):
        self.last, self.prefix, self.numbers, self.parts = source, prefix, itertools.count(1), []

    def put(self, columns: str) -> None:
        name = f"{self.prefix}{next(self.numbers)}"
        self.parts.append(f"{name} AS (SELECT * REPLACE ({columns}) FROM {self.last})")
        self.last = name

    def add(self, columns: str) -> None:
        name = f"{self.prefix}{next(self.numbers)}"
        self.parts.append(f"{name} AS (SELECT *, {columns} FROM {self.last})")
        self.last = name

    def change(self, gate: str, value: str) -> None:
        self.put(f"CASE WHEN {gate} THEN {value} ELSE t END AS t")

    def rewrite(self, gate: str, table: dict[str, list[str]], share: float, step: str, only_one: bool = False,
                any_case: bool = True) -> None:
        if only_one:
            self.put("false AS done")
        for i, (old, news) in enumerate(table.items()):
            fires = f"{gate} AND {found('t', old, any_case)} > 0 AND {chance(step, i)} < {share}"
            new = first_replaced("t", old, picked(news, step, "pick", i), any_case)
            if only_one:
                fires += " AND NOT done"
                self.put(f"CASE WHEN {fires} THEN {new} ELSE t END AS t, done OR ({fires}) AS done")
            else:
                self.change(fires, new)


def cased(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {S.quoted(k)} THEN {S.quoted(v)}" for k, v in values.items()) + " END"


def misspelt(chain: Chain) -> None:
    """t is a place: its rules, then a neighbouring key at one letter."""
    chain.rewrite("t IS NOT NULL", N.STATION_SOUNDS, 0.5, "place", any_case=False)
    keys = S.quoted("".join(N.KEY_NEIGHBOURS))
    chain.add(f"list_filter(range(0, length(t)), lambda i: contains({keys}, lower(substr(t, i + 1, 1)))) AS hit")
    chain.add(f"hit[1 + {below('len(hit)', 'typo')}] AS spot")
    chain.add("substr(t, spot + 1, 1) AS old")
    chain.add(f"{cased(N.KEY_NEIGHBOURS, 'lower(old)')} AS near")
    chain.add(f"substr(near, 1 + {below('length(near)', 'typo', 'key')}, 1) AS new")
    chain.change(f"{chance('typo', 'gate')} < 0.3 AND len(hit) > 0",
                 "substr(t, 1, spot) || CASE WHEN old = upper(old) THEN upper(new) ELSE new END || substr(t, spot + 2)")


def filled(chain: Chain, gate: str) -> None:
    """One to three fillers at different inner positions."""
    chain.add(f"{WORDS} AS w")
    chain.add("len(w) - 1 AS m")
    chain.add(f"{below('least(3, m)', 'fillers', 'n')} + 1 AS k, {below('m', 'fillers', 'a')} AS a")
    chain.add(f"(a + 1 + {below('m - 1', 'fillers', 'b')}) % greatest(m, 1) AS b, {below('m - 2', 'fillers', 'c')} AS c0")
    chain.add("c0 + CASE WHEN c0 >= least(a, b) THEN 1 ELSE 0 END AS c1")
    chain.add("[a, b, c1 + CASE WHEN c1 >= greatest(a, b) THEN 1 ELSE 0 END] AS abc")
    chain.add("list_transform(abc[1:k], lambda p: p + 1) AS places")
    chain.change(f"{gate} AND m >= 1", inserted("w", "places", picked(N.FILLERS, "fillers", "word", ":i")))


def numbers(chain: Chain, gate: str) -> None:
    for i, word in enumerate(N.NUMBER_WORDS, start=1):
        digit, spoken = found("t", str(i), False), found("t", word, True)
        fires = f"{gate} AND {chance('number', i)} < 0.5"
        chain.change(fires, f"CASE WHEN {digit} > 0 THEN {first_replaced('t', str(i), S.quoted(word), False)} "
                            f"WHEN {spoken} > 0 THEN {first_replaced('t', word, S.quoted(str(i)), True)} ELSE t END")


def steps(chain: Chain) -> None:
    """All steps over the sentence in t; g_<step> says whether it applies."""
    filled(chain, "g_filler_words")
    chain.rewrite("g_false_starts", N.FALSE_STARTS, 0.5, "false start", only_one=True)
    at = below(f"len({WORDS})", "repeat")
    chain.change(f"g_repetitions AND len({WORDS}) >= 2",
                 f"CASE WHEN regexp_matches({WORDS}[1 + {at}], '^\\p{{L}}{{2,}}$') THEN "
                 f"{inserted(WORDS, f'[{at}]', f'lower({WORDS}[i + 1])')} ELSE array_to_string({WORDS}, ' ') END")
    least = f"greatest(2, len({WORDS}) // 2)"
    head = f"array_to_string({WORDS}[1:{least} + {below(f'len({WORDS}) - {least}', 'cut')}], ' ')"
    clipped = f"substr({head}, 1, length({head}) - 1 - {below('3', 'cut', 'chars')})"
    chain.change(f"g_incomplete AND len({WORDS}) >= 3",
                 f"CASE WHEN {chance('cut', 'clip')} < 0.3 AND length({head}) > 3 THEN {clipped} ELSE {head} END || "
                 f"{picked(N.CUT_SUFFIXES, 'cut', 'suffix')}")
    chain.rewrite("g_phonetic_confusion", N.PHONETIC_WORDS, 0.4, "sound words")
    chain.rewrite("g_phonetic_confusion", N.PHONETIC_SOUNDS, 0.2, "sounds")
    word = f"{WORDS}[i + 1]"
    bare = f"regexp_replace({word}, '^[.,!?;:''\"]+|[.,!?;:''\"]+$', '', 'g')"
    other = cased(N.HOMOPHONES, f"lower({bare})")
    chain.change("g_homophones", f"array_to_string(list_transform(range(0, len({WORDS})), lambda i: CASE WHEN {other} IS NOT NULL "
                 f"AND {chance('homophone', ':i')} < 0.3 THEN CASE WHEN regexp_matches({bare}, '^\\p{{Lu}}') THEN "
                 f"upper(substr({other}, 1, 1)) || substr({other}, 2) ELSE {other} END || substr({word}, length({bare}) + 1) "
                 f"ELSE {word} END), ' ')")
    comma = (f"array_to_string(list_transform(range(0, len({WORDS})), lambda i: CASE WHEN i = {below(f'len({WORDS}) - 1', 'comma')} "
             f"THEN {word} || ',' ELSE {word} END), ' ')")
    option = f"{drawn('punctuation')} % 4"
    chain.change("g_punctuation_errors", f"CASE WHEN {option} = 0 THEN regexp_replace(t, '[.,!?;:]', '', 'g') "
                 f"WHEN {option} = 1 AND len({WORDS}) > 2 THEN {comma} "
                 f"WHEN {option} = 2 THEN regexp_replace(t, '[.,!?;:]+$', '') || {picked(N.END_MARKS, 'end')} ELSE t END")
    option, letter = f"{drawn('case')} % 4", "substr(lower(t), i + 1, 1)"
    mixed = (f"array_to_string(list_transform(range(0, length(t)), lambda i: CASE WHEN "
             f"(({drawn('case', 'salt')} % 1000003 + 1) * (i + 7919)) % 1000 < 150 THEN upper({letter}) ELSE {letter} END), '')")
    chain.change("g_capitalization_errors", f"CASE WHEN {option} = 0 THEN lower(t) WHEN {option} = 1 THEN {mixed} "
                 f"WHEN {option} = 2 THEN upper(substr(t, 1, 1)) || lower(substr(t, 2)) ELSE t END")
    numbers(chain, "g_number_format")
    chain.rewrite("g_code_switching", N.CODE_SWITCHES, 0.4, "switch", only_one=True)
    phrase = picked(N.HALLUCINATIONS, "hallucination")
    chain.change("g_hallucinations", f"CASE WHEN {drawn('hallucination', 'side')} % 2 = 0 THEN {phrase} || ' ' || t "
                 f"ELSE t || ' ' || {phrase} END")
    places = f"[{below(f'len({WORDS}) + 1', 'marker', 'at')}]"
    chain.change(f"g_noise_artifacts AND len({WORDS}) >= 2", inserted(WORDS, places, picked(N.MARKERS, "marker")))
    south = f"{drawn('accent')} % 2 = 0"
    chain.rewrite(f"g_accent_variations AND {south}", N.SOUTHERN, 0.3, "southern")
    chain.rewrite(f"g_accent_variations AND NOT {south}", N.NORTHERN, 0.3, "northern")


def noisy_ctes(intensity: str) -> tuple[str, str]:
    """(CTEs over 'samples', name of the last one): t is the noisy sentence."""
    def gate(step: str) -> str:
        i = N.STEPS.index(step)
        share = "CASE intensity " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in N.PROFILES.items()) + " ELSE 0 END"
        extra = " AND intent <> 'TRIP'" if step == "incomplete" else ""
        return f"(intensity IS NOT NULL AND {chance(step, 'gate')} < {share}{extra} AND trim(sentence) <> '') AS g_{step}"

    place = Chain("named", "p")
    misspelt(place)
    text = Chain("sentences", "n")
    steps(text)
    return f"""graded AS (SELECT *, {intensity} AS intensity FROM samples),
gated AS (SELECT *, {', '.join(map(gate, N.STEPS))}, CASE WHEN intent = 'TRIP' AND {chance('place', 'use')} < 0.3 THEN
  coalesce(nullif(departure, ''), nullif(destination, '')) END AS place FROM graded),
named AS (SELECT {KEY}, place AS t FROM gated WHERE g_station_misspelling AND place IS NOT NULL),
{', '.join(place.parts)},
sentences AS (SELECT g.*, CASE WHEN p.t IS NOT NULL THEN replace(sentence, place, p.t) ELSE sentence END AS t, false AS done
  FROM gated g LEFT JOIN {place.last} p USING ({KEY})),
{', '.join(text.parts)}""", text.last


FILLED = inserted("w", f"[safe[1 + {below('len(safe)', 'light', 'at')}]]", picked(N.TRAINING_FILLERS, "light", "word"))
RECASED = (f"array_to_string(list_transform(range(0, len(v)), lambda i: CASE WHEN {chance('light', 'case', ':i')} < 0.3 THEN lower(v[i + 1]) "
           f"WHEN {chance('light', 'case', ':i')} < 0.35 THEN upper(v[i + 1]) ELSE v[i + 1] END), ' ')")
#: CTE 'light' over 'samples': a filler outside the slots, then the case of single words.
LIGHT = f"""l0 AS (SELECT *, regexp_extract_all(sentence, '\\S+') AS w,
  regexp_extract_all(lower(concat_ws(' ', departure, destination)), '\\S+') AS used FROM samples),
l1 AS (SELECT *, list_filter(range(1, len(w)), lambda i: NOT list_contains(used, regexp_replace(lower(w[i + 1]), '[.,!?;:''\"]+$', ''))) AS safe FROM l0),
l2 AS (SELECT *, CASE WHEN {chance('light', 'filler')} < 0.3 AND len(w) > 2 AND len(safe) > 0
  THEN regexp_extract_all({FILLED}, '\\S+') ELSE w END AS v FROM l1),
light AS (SELECT * REPLACE (CASE WHEN {chance('light', 'recase')} < 0.5 THEN {RECASED} ELSE array_to_string(v, ' ') END AS sentence) FROM l2)"""
