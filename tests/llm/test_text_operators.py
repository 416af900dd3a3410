"""Spelling variants, fill-in-middle and license scans: twins, brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from railweave.llm import fill_middle, license_scan, spelling
from tests.oracle import compare, connect

COLUMNS = ("doc_id long, text string, word string, n long, form string, output string, one long, two long, "
           "hash long, salt int, label string, spans string, rest string")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names."""
    long = "Under the MIT license " + " ".join(f"worded{chr(97 + i % 9)}x" for i in range(40_000))
    texts = [(1, "stations stations stations stations stations station"), (1, "a<P>b"), (1, "a<P>b"), (2, None),
             (None, None), (None, "ÄÖ 😀 ßtraße"), (None, ""), (3, ""), (4, " \t\n"), (5, long), (6, long), (5, long)]
    return spark.createDataFrame([(i, t, "w", 1, None, "o", 1, 2, 3, 4, "l", None, "r") for i, t in texts], COLUMNS)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_fill_middle", "op13_licenses"])
def test_twin(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), contract.queries()[name], contract.oracle_sql()[name], sf_dir)[2] == []


def near(a: str, b: str) -> bool:
    """One edit apart, by definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    forms, found = {}, {}
    for a in counts:
        mates = [b for b in counts if near(a, b)]
        best = min(mates, key=lambda b: (-counts[b], b), default=None)
        forms[a] = best if best is not None and counts[best] >= ratio * counts[a] else None
        found[a] = len(mates)
    rows = {}
    for a in counts:
        root = a
        while forms[root] is not None:
            root = forms[root]
        rows[a] = (forms[a], root, counts[a], found[a], counts[forms[a]] if forms[a] else None)
    return rows


def made_words(kind: str) -> dict[str, int]:
    rng = random.Random(kind)
    if kind == "dense":  # two letters: nearly every word has near words
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(150)}
    elif kind == "prefix":  # all words begin alike, and some end inside the hot part
        words = {"commonstart" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 4))) for _ in range(120)}
        words |= {"commonstar", "commonstrt", "ommonstart", "commonstartt"}
    else:
        words = {"".join(rng.choice("abcdeéü") for _ in range(rng.randint(6, 7))) for _ in range(120)}
        words |= {w[:3] + w[4:] for w in list(words)[:40]} | {w[:2] + "z" + w[3:] for w in list(words)[:40]}
    return {w: rng.choice([5, 5, 6, 30, 31, 160, 900]) for w in words}


@pytest.mark.parametrize("kind", ["dense", "prefix", "mixed"])
@pytest.mark.parametrize("limit", [1, 7, spelling.LIMIT])
def test_variants_equal_brute_force(spark, kind, limit):
    counts = made_words(kind)
    words = spark.createDataFrame([*counts.items(), (None, 9)], "word string, n long")
    got = spelling.group_variants(words, limit=limit).collect()
    assert len(got) == len(counts)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute(counts)


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(5)) for i in range(60)})
    acceptor = spelling.Acceptor(words)
    rights = set()

    def walk(state, number, read):
        if acceptor.final[state]:
            assert words[number] == read
        for symbol, to in acceptor.edges[state].items():
            walk(to, number + acceptor.first[state][symbol], read + symbol)

    def right(state):
        own = [""] if acceptor.final[state] else []
        return tuple(sorted(own + [s + r for s, to in acceptor.edges[state].items() for r in right(to)]))

    walk(acceptor.root, 0, "")
    rights = [right(s) for s in range(len(acceptor.edges))]
    assert len(set(rights)) == len(rights) and acceptor.size[acceptor.root] == len(words)


def test_long_words_need_no_deep_stack(spark):
    base = "ab" * 3000
    words = {base: 50, base[:-1]: 5, base[:2000] + "x" + base[2001:]: 5, "q" + base[1:]: 5}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["word"]: r["n_near"] for r in got} == {base: 3, **{w: 1 for w in words if w != base}}


def test_occurrences_equal_brute_force(spark, odd):
    want = Counter()
    for r in odd.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            run = run[:h % len(run)] + run[h % len(run) + 1:] if h % 7 == 0 else run
            want[run] += len(run) >= 6
    got = spelling.vocabulary(spelling.occurrences(odd, modulus=7)).collect()
    assert {r["word"]: r["n"] for r in got} == {w: n for w, n in want.items() if n >= 5}


def test_spelling_of_odd_rows(spark, odd):
    got = {r["word"]: r for r in spelling.spelling_variants(odd).collect()}
    assert got["stations"]["n"] == 5 and got["stations"]["root"] == "stations"
    assert sum(r["n"] for r in got.values()) >= 3 * 40_000
    for rows in (odd.limit(0), odd.filter(F.col("text").isNull())):
        assert spelling.spelling_variants(rows).count() == 0


TEXTS = st.text(alphabet=st.sampled_from("ab Z<>PSM\n\x00é😀"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 1 << 20), st.integers(0, 1 << 20), st.sampled_from(["psm", "spm", "plain"]))
def test_piece_table_round_trip(text, x, y, form):
    raw = text.encode()
    borders = [len(text[:i].encode()) for i in range(len(text) + 1)]
    low, high = sorted((borders[x % len(borders)], borders[y % len(borders)]))
    if form != "plain" and any(s in raw for s in (b"<P>", b"<S>", b"<M>")):
        return
    table = fill_middle.arrange(raw, low, high, form)
    p, m, s = raw[:low], raw[low:high], raw[high:]
    want = {"psm": b"<P>" + p + b"<S>" + s + b"<M>" + m, "spm": b"<S>" + s + b"<P>" + p + b"<M>" + m, "plain": raw}[form]
    assert table.bytes() == want and table.sha256() == hashlib.sha256(want).hexdigest()
    assert table.unmarked().arranged((0,) if form == "plain" else tuple(
        fill_middle.ARRANGEMENTS[form].index(i) for i in range(3))).bytes() == raw
    assert fill_middle.restored(want, form).bytes() == raw


def test_fill_in_middle_of_odd_rows(spark, odd):
    rows = fill_middle.fill_in_middle(odd)
    got = rows.collect()
    assert len(got) == odd.count()
    texts = sorted((r["text"] or "") for r in odd.collect())
    assert sorted(r["restored"] for r in fill_middle.restore(rows).collect()) == texts
    for r in got:
        text = fill_middle.restored(r["output"].encode(), r["form"]).bytes().decode()
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert r["n"] == len(tokens) and r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
        assert ("<P>" in text or not text) <= (r["form"] == "plain") and (r["prefix_chars"] is None) == (r["form"] == "plain")
        if r["form"] != "plain":
            h = fill_middle.draws(r["doc_id"])
            low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
            assert (r["prefix_chars"], r["middle_chars"]) == (len("".join(tokens[:low])), len("".join(tokens[low:high])))
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_licenses_of_changed_notices(spark):
    notice = license_scan.NOTICES[0][0].split()
    holes = " ".join(w for i, w in enumerate(notice) if i not in (7, 18))
    stuffed = " ".join(notice[:9] + ["hereby", "and", "now"] + notice[9:])
    rows = [(1, "x " * 50 + holes), (2, stuffed + " tail"), (3, " ".join(notice[:8])), (4, " ".join(sorted(notice))),
            (5, "Under  the--MIT\nlicense, under the mit license; CC-BY-NC"), (6, "under the mit licenses"),
            (7, "apache license (version 2) and " + license_scan.NOTICES[4][0])]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and 0.6 < got[1]["score"] < 1 and got[1]["spans"][0]["first"] == 50
    assert got[2]["labels"] == "mit" and [(s["first"], s["last"]) for s in got[2]["spans"]] == [(0, len(notice) + 2)]
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.6
    assert got[4]["labels"] == ""
    five = got[5]
    assert (five["n_base"], five["first_word"], five["last_word"], five["base_labels"]) == (3, 0, 8, "cc-by-nc,mit")
    assert got[6]["n_base"] == 0 and got[6]["base_labels"] == ""
    assert got[7]["labels"] == "apache-2,gpl-3" and got[7]["base_labels"] == "apache-2"


def test_licenses_of_odd_rows(spark, odd):
    got = license_scan.scan_licenses(odd).collect()
    assert len(got) == odd.count()
    assert sorted((r["doc_id"] or 0, r["n_base"], r["n_words"]) for r in got)[-3:] == [(5, 1, 40004)] * 2 + [(6, 1, 40004)]
    assert all(r["labels"] == "" and r["score"] == 0 for r in got if (r["doc_id"] or 0) < 5)
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0
    none = license_scan.templates(spark, [], [])
    assert license_scan.scan_licenses(odd, none).agg(F.sum("n_base")).first()[0] == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(odd, license_scan.templates(spark, [("two words", "x")], []))
