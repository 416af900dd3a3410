"""Transcription noise as one lazy job (K10, K10a-d, K11, B29).

Every random decision is a hash of (seed, row id, step), so a row gets the same noise in
any file, on any cluster and on any retry.  Rewrites fold over literal rule arrays and
each step is its own projection, which keeps the expressions linear in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions import noise_tables as N
from railweave.functions.bio import TAIL_PUNCTUATION, positions
from railweave.functions.labels import rename_id
from railweave.functions.text import bind, words
from railweave.operators.scale import hash_int, uniform


class Dice:
    """Repeatable draws for one row: ``u`` in [0, 1), ``pick`` an element, ``below`` an int."""

    def __init__(self, row_id: Column, seed: int):
        self.row_id, self.seed = row_id, seed

    def u(self, *step) -> Column:
        return uniform(self.seed, self.row_id, *map(_part, step))

    def below(self, n: Column | int, *step) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return F.pmod(hash_int(self.seed, self.row_id, *map(_part, step)),
                      F.greatest(n, F.lit(1))).cast("int")

    def pick(self, items: Column, *step) -> Column:
        return F.get(items, self.below(F.size(items), *step))


def _part(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def _rules(table: dict[str, list[str]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(key).alias("old"),
                              literals(news).alias("news"))
                     for i, (key, news) in enumerate(table.items())])


def replace_at(text: Column, start: Column, length: Column, new: Column) -> Column:
    """Replace ``length`` characters from 1-based ``start``."""
    return F.concat(F.substring(text, F.lit(1), start - 1), new,
                    F.substring(text, start + length, F.length(text)))


def _find(needle: Column, text: Column, any_case: bool) -> Column:
    if any_case:
        needle, text = F.lower(needle), F.lower(text)
    return F.call_function("locate", needle, text)


def rewrite(text: Column, table: dict[str, list[str]], chance: float, dice: Dice, step: str,
            only_one: bool = False, any_case: bool = True) -> Column:
    """Each rule found in the text replaces its first occurrence with some chance.

    With ``only_one`` the first rule that fires ends the step.
    """
    start = F.struct(text.alias("text"), F.lit(False).alias("done"))

    def apply(state: Column, rule: Column) -> Column:
        value = state["text"]
        at = _find(rule["old"], value, any_case)
        fires = (at > 0) & (dice.u(step, rule["i"]) < chance)
        if only_one:
            fires = ~state["done"] & fires
        changed = replace_at(value, at, F.length(rule["old"]),
                             dice.pick(rule["news"], step, "pick", rule["i"]))
        return F.when(fires, F.struct(changed.alias("text"), F.lit(True).alias("done"))).otherwise(
            state)

    return F.aggregate(_rules(table), start, apply, lambda s: s["text"])


def insert_words(tokens: Column, places: Column, word_at) -> Column:
    """Put ``word_at(position)`` before each listed token position; n means the end."""
    def place(at: Column) -> Column:
        placed = F.flatten(F.transform(tokens, lambda w, i: F.when(
            F.array_contains(at, i), F.array(word_at(i), w)).otherwise(F.array(w))))
        end = F.size(tokens)
        return F.when(F.array_contains(at, end),
                      F.concat(placed, F.array(word_at(end)))).otherwise(placed)

    return bind(places, place)


def distinct_picks(n: Column, k: Column, dice: Dice, step: str) -> Column:
    """Up to three different numbers below n."""
    a = dice.below(n, step, "a")
    b = F.pmod(a + 1 + dice.below(n - 1, step, "b"), F.greatest(n, F.lit(1)))
    low, high = F.least(a, b), F.greatest(a, b)
    c = dice.below(n - 2, step, "c")
    c = c + F.when(c >= low, 1).otherwise(0)
    c = c + F.when(c >= high, 1).otherwise(0)
    return F.slice(F.array(a, b, c), F.lit(1), k)


def add_fillers(text: Column, dice: Dice) -> Column:
    """One to three fillers at different inner positions."""
    return bind(words(text), lambda tokens: _with_fillers(text, tokens, dice))


def _with_fillers(text: Column, tokens: Column, dice: Dice) -> Column:
    n = F.size(tokens)
    count = dice.below(F.least(F.lit(3), n - 1), "fillers", "n") + 1
    places = F.transform(distinct_picks(n - 1, count, dice, "fillers"), lambda p: p + 1)
    filled = insert_words(tokens, places,
                          lambda i: dice.pick(literals(N.FILLERS), "fillers", "word", i))
    return F.when(n < 2, text).otherwise(F.array_join(filled, " "))


def repeat_word(text: Column, dice: Dice) -> Column:
    """Stutter one word of letters."""
    def repeat(tokens: Column) -> Column:
        at = dice.below(F.size(tokens), "repeat")
        word = F.get(tokens, at)
        doubled = insert_words(tokens, F.array(at), lambda i: F.lower(F.get(tokens, i)))
        return F.when(F.size(tokens) < 2, text).when(
            word.rlike(r"^\p{L}{2,}$"), F.array_join(doubled, " ")
        ).otherwise(F.array_join(tokens, " "))

    return bind(words(text), repeat)


def cut_short(text: Column, dice: Dice) -> Column:
    """Keep a head of at least half the words, perhaps cut its last word, add a suffix."""
    return bind(words(text), lambda tokens: _cut(text, tokens, dice))


def _cut(text: Column, tokens: Column, dice: Dice) -> Column:
    n = F.size(tokens)
    least = F.greatest(F.lit(2), F.floor(n / 2).cast("int"))
    head = F.array_join(F.slice(tokens, F.lit(1), least + dice.below(n - least, "cut")), " ")
    clip = (dice.u("cut", "clip") < 0.3) & (F.length(head) > 3)
    clipped = F.substring(head, F.lit(1), F.length(head) - 1 - dice.below(3, "cut", "chars"))
    return F.when(n < 3, text).otherwise(F.concat(
        F.when(clip, clipped).otherwise(head),
        dice.pick(literals(N.CUT_SUFFIXES), "cut", "suffix")))


def swap_homophones(text: Column, dice: Dice) -> Column:
    """Homophones word by word, keeping the first letter's case and the tail."""
    table = F.create_map(*[F.lit(v) for pair in N.HOMOPHONES.items() for v in pair])

    def swap(word: Column, i: Column) -> Column:
        bare = F.regexp_replace(word, "^[.,!?;:'\"]+|[.,!?;:'\"]+$", "")
        other = F.try_element_at(table, F.lower(bare))
        cased = F.when(bare.rlike(r"^\p{Lu}"), F.concat(
            F.upper(F.substring(other, 1, 1)), F.substr(other, F.lit(2)))).otherwise(other)
        return F.when(other.isNotNull() & (dice.u("homophone", i) < 0.3),
                      F.concat(cased, F.substring(word, F.length(bare) + 1, F.length(word)))
                      ).otherwise(word)

    return F.array_join(F.transform(words(text), swap), " ")


def change_punctuation(text: Column, dice: Dice) -> Column:
    """Drop all, add a comma, change the end, or leave it."""
    option = dice.below(4, "punctuation")
    tokens = words(text)
    comma = bind(dice.below(F.size(tokens) - 1, "comma"), lambda at: F.array_join(
        F.transform(tokens, lambda w, i: F.when(
            i == at, F.concat(w, F.lit(","))).otherwise(w)), " "))
    ended = F.concat(F.regexp_replace(text, "[.,!?;:]+$", ""),
                     dice.pick(literals(N.END_MARKS), "end"))
    return F.when(option == 0, F.regexp_replace(text, "[.,!?;:]", "")).when(
        (option == 1) & (F.size(tokens) > 2), comma).when(option == 2, ended).otherwise(text)


def change_case(text: Column, dice: Dice) -> Column:
    """All lower, random capitals, first capital only, or leave it."""
    option = dice.below(4, "case")
    # 15 % of the characters, from one draw per row and the position
    mixed = bind(dice.below(1_000_003, "case", "salt").cast("bigint"), lambda salt: F.array_join(
        F.transform(F.split(F.lower(text), ""), lambda c, i: F.when(
            F.pmod((salt + 1) * (i + 7919), F.lit(1000)) < 150, F.upper(c)).otherwise(c)), ""))
    first = F.concat(F.upper(F.substring(text, 1, 1)),
                     F.lower(F.substring(text, F.lit(2), F.length(text))))
    return F.when(option == 0, F.lower(text)).when(option == 1, mixed).when(
        option == 2, first).otherwise(text)


def vary_numbers(text: Column, dice: Dice) -> Column:
    """Digits to words or words to digits, first occurrence, half of the time."""
    rules = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(str(i)).alias("digit"),
                               F.lit(w).alias("word"))
                      for i, w in enumerate(N.NUMBER_WORDS, start=1)])

    def apply(value: Column, rule: Column) -> Column:
        digit = _find(rule["digit"], value, False)
        word = _find(rule["word"], value, True)
        fires = dice.u("number", rule["i"]) < 0.5
        return F.when(digit > 0, F.when(fires, replace_at(
            value, digit, F.length(rule["digit"]), rule["word"])).otherwise(value)).when(
            (word > 0) & fires, replace_at(value, word, F.length(rule["word"]), rule["digit"])
        ).otherwise(value)

    return F.aggregate(rules, text, apply)


def add_hallucination(text: Column, dice: Dice) -> Column:
    """A stock phrase before or behind."""
    phrase = dice.pick(literals(N.HALLUCINATIONS), "hallucination")
    return F.when(dice.below(2, "hallucination", "side") == 0, F.concat_ws(" ", phrase, text)
                  ).otherwise(F.concat_ws(" ", text, phrase))


def add_marker(text: Column, dice: Dice) -> Column:
    """A noise marker between any two words."""
    def mark(tokens: Column) -> Column:
        at = dice.below(F.size(tokens) + 1, "marker", "at")
        marker = dice.pick(literals(N.MARKERS), "marker")
        return F.when(F.size(tokens) < 2, text).otherwise(
            F.array_join(insert_words(tokens, F.array(at), lambda i: marker), " "))

    return bind(words(text), mark)


def add_accent(text: Column, dice: Dice) -> Column:
    """One of two regional tables."""
    return F.when(dice.below(2, "accent") == 0, rewrite(text, N.SOUTHERN, 0.3, dice, "southern")
                  ).otherwise(rewrite(text, N.NORTHERN, 0.3, dice, "northern"))


def confuse_sounds(text: Column, dice: Dice) -> Column:
    """Word errors, then sound errors."""
    spoken = rewrite(text, N.PHONETIC_WORDS, 0.4, dice, "sound words")
    return rewrite(spoken, N.PHONETIC_SOUNDS, 0.2, dice, "sounds")


def misspell_place(name: Column, dice: Dice) -> Column:
    """K10d: place rules, then with 30 % a neighbouring key at one letter."""
    spelled = rewrite(name, N.STATION_SOUNDS, 0.5, dice, "place", any_case=False)
    table = F.create_map(*[F.lit(v) for pair in N.KEY_NEIGHBOURS.items() for v in pair])

    def typo(value: Column) -> Column:
        keys = F.filter(positions(F.split(value, "")), lambda i: F.try_element_at(
            table, F.lower(F.substring(value, i + 1, F.lit(1)))).isNotNull())
        at = dice.pick(keys, "typo")
        old = F.substring(value, at + 1, F.lit(1))
        near = F.try_element_at(table, F.lower(old))
        new = F.substring(near, dice.below(F.length(near), "typo", "key") + 1, F.lit(1))
        cased = F.when(old == F.upper(old), F.upper(new)).otherwise(new)
        return F.when(F.size(keys) > 0, replace_at(value, at + 1, F.lit(1), cased)).otherwise(value)

    return F.when(dice.u("typo", "gate") < 0.3,
                  F.element_at(F.transform(F.array(spelled), typo), 1)).otherwise(spelled)


# step name -> transform, in the order in which they are applied
TRANSFORMS = [
    ("filler_words", add_fillers),
    ("false_starts", lambda t, d: rewrite(t, N.FALSE_STARTS, 0.5, d, "false start", only_one=True)),
    ("repetitions", repeat_word),
    ("incomplete", cut_short),
    ("phonetic_confusion", confuse_sounds),
    ("homophones", swap_homophones),
    ("punctuation_errors", change_punctuation),
    ("capitalization_errors", change_case),
    ("number_format", vary_numbers),
    ("code_switching", lambda t, d: rewrite(t, N.CODE_SWITCHES, 0.4, d, "switch", only_one=True)),
    ("hallucinations", add_hallucination),
    ("noise_artifacts", add_marker),
    ("accent_variations", add_accent),
]


def pick_intensity(intent: Column, dice: Dice) -> Column:
    """20/40/30/10 for TRIP; 30 % of NOT_TRIP get light or moderate; others none."""
    draw = dice.u("intensity")
    trip = None
    for name, end in N.INTENSITY_ENDS:
        trip = F.when(draw < end, name) if trip is None else trip.when(draw < end, name)
    touched = dice.u("touch") < 0.3
    return F.when(intent == "TRIP", trip).when(
        (intent == "NOT_TRIP") & touched,
        F.when(dice.below(2, "light or moderate") == 0, "light").otherwise("moderate"))


def step_fires(step: str, intensity: Column, intent: Column, dice: Dice) -> Column:
    """Whether a step applies; TRIP rows are never cut short."""
    index = N.STEPS.index(step)
    chance = F.lit(0.0)
    for name, values in N.PROFILES.items():
        chance = F.when(intensity == name, F.lit(values[index])).otherwise(chance)
    fires = intensity.isNotNull() & (dice.u(step, "gate") < chance)
    return fires & (intent != "TRIP") if step == "incomplete" else fires


def noise_plan(df: DataFrame, key: str = "sentence_id", seed: int = 42) -> DataFrame:
    """(key, intensity, steps): what K10 is going to do to each row."""
    dice = Dice(F.col(key), seed)
    planned = df.withColumn("intensity", pick_intensity(F.col("intent"), dice))
    fired = F.filter(F.array(*[
        F.when(step_fires(step, F.col("intensity"), F.col("intent"), dice), step)
        for step, _ in TRANSFORMS]), lambda s: s.isNotNull())
    return planned.select(key, "intensity", fired.alias("steps"))


def augment(df: DataFrame, key: str = "sentence_id", seed: int = 42) -> DataFrame:
    """Noisy sentences; labels and slots stay, ids move from BASE to STT."""
    dice = Dice(F.col(key), seed)
    text, intent, intensity = F.col("_text"), F.col("intent"), F.col("_intensity")
    place = F.coalesce(F.nullif("departure", F.lit("")), F.nullif("destination", F.lit("")))
    noisy = df.withColumns({
        "_text": F.col("sentence"), "_intensity": pick_intensity(intent, dice),
        "_place": F.when((intent == "TRIP") & (dice.u("place", "use") < 0.3), place)})
    misspelt = F.when(F.col("_place").isNotNull() & step_fires(
        "station_misspelling", intensity, intent, dice), misspell_place(F.col("_place"), dice))
    noisy = noisy.withColumn("_new_place", misspelt).withColumn(
        "_text", F.when(F.col("_new_place").isNotNull(),
                        F.replace(text, F.col("_place"), F.col("_new_place"))).otherwise(text))
    for step, transform in TRANSFORMS:
        fires = step_fires(step, intensity, intent, dice) & (F.trim("sentence") != "")
        noisy = noisy.withColumn("_text", F.when(fires, transform(text, dice)).otherwise(text))
    return noisy.withColumns({"sentence": text, key: rename_id(F.col(key))}).select(*df.columns)


def augment_lightly(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A filler outside the entities (30 %), then random case per word (50 %)."""
    dice = Dice(F.col(key), seed)
    tokens, safe = F.col("_tokens"), F.col("_safe")
    slots = F.col("_slots")
    bare = F.transform(tokens, lambda w: F.regexp_replace(F.lower(w), TAIL_PUNCTUATION, ""))
    ready = df.withColumns({
        "_tokens": words(F.col("sentence")),
        "_slots": words(F.lower(F.concat_ws(" ", "departure", "destination")))}).withColumn(
        "_safe", bind(bare, lambda b: F.filter(positions(b), lambda i: (i > 0)
                                               & ~F.array_contains(slots, F.get(b, i)))))
    add = (dice.u("light", "filler") < 0.3) & (F.size(tokens) > 2) & (F.size(safe) > 0)
    filled = F.when(add, insert_words(
        tokens, F.array(dice.pick(safe, "light", "at")),
        lambda i: dice.pick(literals(N.TRAINING_FILLERS), "light", "word"))).otherwise(tokens)

    def recase(word: Column, i: Column) -> Column:
        draw = dice.u("light", "case", i)
        return F.when(draw < 0.3, F.lower(word)).when(draw < 0.35, F.upper(word)).otherwise(word)

    cased = F.when(dice.u("light", "recase") < 0.5, F.transform(F.col("_words"), recase)
                   ).otherwise(F.col("_words"))
    return ready.withColumn("_words", filled).withColumn(
        "sentence", F.array_join(cased, " ")).select(*df.columns)
