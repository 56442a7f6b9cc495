"""Correction of lines by tables against a plain version that tries every rule at every place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import correct, occurrences
from lectern.plans import query_correct, views

#: Readings of a few characters, with tones, as they are spoken.
TONED = {"工": "gong1", "公": "gong1", "單": "dan1", "生": "sheng1", "升": "sheng1", "管": "guan3", "館": "guan3", "官": "guan1", "治": "zhi4", "直": "zhi2", "具": "ju4", "距": "ju4", "料": "liao4", "號": "hao4", "好": "hao3", "了": "le1", "供": "gong1", "需": "xu1", "序": "xu4"}
READINGS = [(c, r[:-1], r) for c, r in TONED.items()]
LATIN = re.compile(r"[A-Za-zÀ-ỹ][A-Za-zÀ-ỹ'’-]*")


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(text, terms, pairs=(), readings=READINGS, letters="[一-鿿]"):
    """The rules as the survey states them: aliases at each place, then every term in turn on what is there by then."""
    bare, toned = {c: a for c, a, _ in readings}, {c: b for c, _, b in readings}
    read = lambda t, by: "".join(by.get(c, c) for c in t)
    known = {s for s, _ in terms}
    wrong = {w: r for w, r in pairs if w and w not in known}
    out = at = 0
    out = ""
    while at < len(text):
        w = max((w for w in wrong if text.startswith(w, at)), key=len, default=None)
        out, at = (out + wrong[w], at + len(w)) if w else (out + text[at], at + 1)
    heard = [(s, read(s, bare)) for s, m in terms if m != "protect" and re.search(letters, s) and len(read(s, bare)) >= 4]
    spelled = [(s, s.lower()) for s, m in terms if m != "protect" and not re.search(letters, s) and len(s) >= 4]
    for term, key in sorted({*heard, *spelled}, key=lambda r: (-len(r[0]), r[0])):
        if (term, key) in spelled:
            most = int(len(key) * 0.25) if len(key) >= 6 else 0
            out = LATIN.sub(lambda m, term=term, key=key, most=most: term if m[0] != term and edits(m[0].lower(), key) <= most else m[0], out)
            continue
        made, at, n = "", 0, len(term)
        while at < len(out):
            w = out[at : at + n]
            fits = len(w) == n and w not in known and all(re.fullmatch(letters, c) for c in w) and read(w, bare) == key
            if fits and min((edits(read(t, toned), read(w, toned)), t) for t, k in heard if k == key and len(t) == n)[1] == term:
                made, at = made + term, at + n
            else:
                made, at = made + out[at], at + 1
        out = made
    return out


def run(spark, texts, terms, pairs=(), letters=None, readings=READINGS):
    lines = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "line_id long, source string, text string")
    known = spark.createDataFrame([(k, s, m) for k, (s, m) in enumerate(terms)], "id long, source string, mode string")
    learned = spark.createDataFrame(list(pairs), "wrong string, right string") if pairs else None
    heard = spark.createDataFrame(readings, "char string, toneless string, toned string")
    more = {} if letters is None else {"letters": letters}
    got = correct.corrected(lines, known, learned, heard, **more).collect()
    assert all(r["text"] == "own" for r in got)
    return [r.fixed for r in sorted(got, key=lambda r: r.line_id)]


def test_lines_of_real_han(spark):
    terms = [("工單", "hint"), ("生管", "hint"), ("升官", "hint"), ("治具", "keep"), ("料號", "translate"), ("公館", "protect"), ("Vincent", "keep"), ("公序", "hint")]
    texts = ["公單的管理", "生館的事", "升官的事", "直距和治具", "公館公單", "incent and Vincents came", "wind", "生館公單直距", "料好了", "", None, "了公單生官管"]
    want = [t if not t else plain(t, terms) for t in texts]
    assert want[:4] == ["工單的管理", "生管的事", "升官的事", "治具和治具"] and want[4] == "公館工單" and want[5] == "Vincent and Vincent came" and want[6] == "wind"
    assert run(spark, texts, terms) == want


def test_learned_pairs_are_not_read_again_and_known_words_are_never_wrong(spark):
    assert run(spark, ["生館的事", "aaab"], [("xyz", "hint")], [("生館", "生管"), ("生管", "升官"), ("a", "b"), ("aa", "c"), ("b", "")]) == ["生管的事", "cb"]
    assert run(spark, ["生館"], [("生館", "hint")], [("生館", "生管")]) == ["生館"]


@pytest.mark.parametrize("seed", range(3))
def test_random_lines_equal_the_plain_version(spark, seed):
    draw = random.Random(seed)
    han = "".join(TONED)
    word = lambda: "".join(draw.choice("abcdef'-é") for _ in range(draw.randint(3, 9))).strip("'-") or "abc"
    terms = {("".join(draw.choice(han) for _ in range(draw.choice([2, 2, 3]))), draw.choice(["hint", "protect"])) for _ in range(25)}
    base = [word() for _ in range(12)]
    terms |= {(t, draw.choice(["keep", "protect", "hint"])) for t in base} | {(f"{base[0]} {base[1]}x", "hint"), (base[2] + "q", "keep")}
    terms = [t for k, t in enumerate(sorted(terms)) if t[0] not in {s for s, _ in sorted(terms)[:k]}]

    def near(t):
        w = list(t)
        for _ in range(draw.randint(0, 2)):
            w[draw.randrange(len(w)) : draw.randrange(len(w)) + 1] = [draw.choice("abcdefz")]
        return "".join(w)

    texts = [" ".join(draw.choice([near(draw.choice(base)), "".join(draw.choice(han) for _ in range(draw.randint(1, 9))), word(), draw.choice(base).title()]) for _ in range(draw.randint(1, 8))) for _ in range(150)]
    pairs = [("工公", "單"), ("ab", "fed"), ("ef", "公單"), (base[3], base[4])]
    assert run(spark, texts, terms, pairs) == [plain(t, terms, pairs) for t in texts]


def test_registered_queries_equal_the_plain_version(spark, sf_dir):
    lines, terms = views.view(spark, sf_dir, "lines").limit(60), views.view(spark, sf_dir, "terms")
    text = {r.line_id: r.source for r in lines.collect()}
    rows = [(r.source, r.mode) for r in terms.collect()]
    pairs = [tuple(r) for r in query_correct.pairs_of(terms).collect()]
    sounds = [tuple(r) for r in query_correct.readings(spark).collect()]
    assert {r.line_id: r.fixed for r in query_correct.cor5(lines, terms).collect()} == {k: plain(t, rows, pairs, sounds, "[à-ÿ]") for k, t in text.items()}
    low = [(s.lower(), m) for s, m in rows]
    heard = lambda t: plain(t, low, (), sounds, "[a-z]")
    assert {r.line_id: r.fixed for r in query_correct.cor3(lines, terms).collect()} == {k: heard(t) for k, t in text.items()}
    assert {r.line_id: r.fixed for r in query_correct.cor1(lines, terms).collect()} == {k: plain(t, [(s, "protect") for s, _ in rows], pairs) for k, t in text.items()}


def test_near_terms_equal_all_pairs_and_never_loop(spark):
    draw = random.Random(4)
    words = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 24))) for _ in range(250)}
    rules = [(f"T{k}", w, draw.choice([0, 1, 2, 3, 5])) for k, w in enumerate(sorted(words)[:120]) if len(w) > 3]
    rules = [(t, k, min(m, len(k) // 2)) for t, k, m in rules]
    tokens = spark.createDataFrame([(w,) for w in words] + [(None,)], "token string")
    got = correct.near_terms(tokens, spark.createDataFrame(rules, "term string, key string, most int"))
    assert sorted(map(tuple, got.collect())) == sorted((w, t) for w in words for t, k, m in rules if edits(w, k) <= m)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_occurrences_by_slices_and_by_grams_equal_contains(spark):
    draw = random.Random(6)
    word = lambda a, b: "".join(draw.choice("abcé公") for _ in range(draw.randint(a, b)))
    texts = [(word(0, 30),) for _ in range(120)] + [(None,), ("",), ("abcabc",), ("abcabc",)]
    terms = [(word(1, 6),) for _ in range(90)] + [("",), (None,), ("zz" * 40,)]
    a, b = spark.createDataFrame(texts, "text string"), spark.createDataFrame(terms, "term string")
    want = sorted({(t, w) for (t,) in texts for (w,) in terms if t and w and w in t})
    for some in (occurrences.occurrences(a, b), occurrences.occurrences(a, b, slice_terms=20), occurrences.occurrences(a, b, slice_terms=1)):
        assert sorted(map(tuple, some.collect())) == want
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert occurrences.occurrences(a, b.limit(0)).count() == occurrences.occurrences(a.limit(0), b).count() == 0
