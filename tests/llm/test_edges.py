"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with the operators' own names."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import decision_list, hmm, mixing, pii, ppm, sentence_spans, simhash, tiling, warc, weak_labels

LONG = "alpha beta. gamma, delta " * 8000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("id", "row", "size", "kept", "component", "fp", "spans", "score", "label", "copies", "n_words", "removed", "item_id", "coverage", "train", "rule", "taken", "bytes", "digest")


@pytest.fixture(scope="module")
def odd(spark):
    text = "The quick brown fox jumps over the lazy dog near the river bank. It was late. Nobody saw it go away then."
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, text, "en", "a", None), (3, LONG, "en", "b", len(LONG)), (4, text, "en", "a", 5), (4, text, "en", "a", 5), (4, text + " More words.", "fr", None, 6), (5, "1234 5678 !!", None, "b", 1), (6, " \t\n\x0b ", "de", "c", 4), (7, "x" * 30000, "de", "c", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in EXTRA))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", "x"), (2, None, "x"), (None, "", "x"), (1, "quick brown fox jumps over the lazy dog", "x")], "item_id long, text string, row string")


SMALL = hmm.Settings(states=2, symbols=5, sent=5, rounds=2)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_every_operator_gives_a_row_per_row(which, request, labels):
    df = request.getfixturevalue(which)
    n = df.count()
    train = F.col("doc_id") % 2 == 0
    for got in (
        hmm.score(df, train, settings=SMALL),
        mixing.pivotal_copies(df),
        ppm.predict(df, ppm.train(df)),
        simhash.near_duplicates(df),
        decision_list.judge(df, labels),
        weak_labels.classify(df),
        pii.find(df),
        pii.masked(df),
        sentence_spans.without_repeats(df),
    ):
        assert got.count() == n, got.columns


@pytest.mark.parametrize("which", ["odd", "none"])
def test_filters_and_pairs(which, request, bench, labels):
    df = request.getfixturevalue(which)
    n = df.count()
    bad = tiling.contaminated(df, bench)
    assert bad.count() == (0 if n == 0 else 3)  # the null id, and both texts of id 4; rows repeated in full report once
    assert tiling.decontaminate(df, bench).count() == (0 if n == 0 else n - 4)
    assert sorted(r.doc_id for r in sentence_spans.repeated_spans(df).collect()) == ([] if n == 0 else [3, 4, 4])
    assert decision_list.kept_rows(df, labels).count() <= n
    assert mixing.mixture(df).count() <= n
    assert tiling.contaminated(df, bench.limit(0)).count() == 0


def test_values_of_odd_rows(odd):
    near = {(r.doc_id, r.fp): r.component for r in simhash.near_duplicates(odd).collect()}
    assert near[1, 0] == near[2, 0] == near[6, 0] == 1
    lang = {r.doc_id: (r.lang_pred, r.score) for r in ppm.predict(odd, ppm.train(odd)).collect()}
    assert lang[1] == lang[2] == lang[5] == lang[6] == ("und", 0.0) and lang[3][0] == "en"
    assert ppm.train(odd.limit(0)) == []
    score = {r.doc_id: r for r in hmm.score(odd, F.col("doc_id") % 2 == 0, settings=SMALL).collect()}
    assert score[1].n_tokens == score[2].n_tokens == score[6].n_tokens == 1 and score[7].n_tokens == 2
    assert all(r.score <= 0 and r.base_score <= 0 for r in score.values())
    size = {r.doc_id: r["size"] for r in mixing.pivotal_copies(odd).collect()}
    assert (size[1], size[2], size[3], size[7]) == (0, 0, 32000, 1)


def test_control_characters_are_no_blanks_unless_ascii_blanks(spark, labels, bench):
    """\x1c to \x1f, \x85, \x00 and U+2028 are parts of words everywhere."""
    marks = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\x00", "\u2028"]
    shared = "One two\x1cthree four. Five six\x85seven eight. Nine\x1f ten eleven \x1d twelve. More words\u2028here to end it."
    rows = [(k, m) for k, m in enumerate(marks)] + [(10, f"a {marks[0]} b"), (11, "two\x1cthree"), (12, f"Lead\x1e in. {shared}"), (13, f"Another. {shared}")]
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], SCHEMA)
    lost = {r.doc_id: [(x.start, x.end) for x in r.removed] for r in sentence_spans.repeated_spans(df).collect()}
    assert lost == {13: [(9, 9 + len(shared))]}
    n = df.count()
    for got in (hmm.score(df, F.col("doc_id") % 2 == 0, settings=SMALL), ppm.predict(df, ppm.train(df)), simhash.near_duplicates(df), weak_labels.classify(df), pii.find(df), sentence_spans.without_repeats(df)):
        assert got.count() == n
    assert {r.doc_id: r["size"] for r in mixing.pivotal_copies(df).collect()} == {k: len(t.encode().split()) for k, t in rows}
    assert {r["doc_id"]: r.n_words for r in decision_list.statistics(df, keep=["doc_id"]).select("doc.doc_id", "n_words").collect()} == {k: len(t.encode().split()) for k, t in rows}
    assert tiling.contaminated(df, bench).count() == 0


def test_warc_of_odd_pages(spark):
    big = "y" * 200
    rows = [(1, "http://a.com/x", None, 0), (2, "http://a.com/x", "", 0), (3, None, big, 0), (4, "http://b.com/\r\nX: y", big, 0), (None, "http://a.com", big, 0), (5, "not a url ]", "small", 0), (6, "x", "small", 0), (7, "http://a.com/x", "WARC/1.1\r\n\r\n\r\nContent-Length: 9\r\n\r\n" * 9, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id int")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.capture_histories(pages).collect()}
    assert got == {1: ("response", None, 0), 2: ("response", None, 0), 3: ("response", None, 200), 4: ("revisit", 3, 200), None: ("revisit", 3, 200), 5: ("response", None, 5), 6: ("response", None, 5), 7: ("response", None, 315)}
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_rules_without_usable_labels(spark, odd):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    stats = decision_list.statistics(odd)
    assert decision_list.learn_rules(stats, nothing) == []
    one = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    assert decision_list.learn_rules(stats, one) == []


def test_long_digit_and_symbol_runs_do_not_break_patterns(spark):
    texts = ["1 " * 20000, "7" * 50000, "a@" + "b." * 20000, "a." * 20000 + "@x.y", "+" + "1 " * 30000, "1." * 30000, "((at)" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find(df).count() == len(texts)


def test_columns_of_any_name_keep_their_values(spark, bench):
    names = ("_key", "_row", "_id", "_c", "_text", "_email", "_w_phone", "_n", "_h", "_size", "_source", "_all", "id", "row", "key", "doc", "size", "copies", "taken", "contaminated")
    rows = [(1, "write to ann@example.org soon", "en", "a", 29), (2, "a quick brown fox jumps over the lazy dog", "en", "b", 41), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("own").alias(c) for c in names))
    for got, ids in ((pii.masked(df), {1, 2, 3}), (tiling.decontaminate(df, bench), {1, 3}), (mixing.mixture(df), None)):
        found = got.collect()
        assert found and all(r[c] == "own" for r in found for c in names)
        assert got.columns[: len(df.columns)] == df.columns and (ids is None or {r.doc_id for r in found} == ids)
    assert mixing.mixture(df).columns[-3:] == ["size_", "copies_", "taken_"]


def test_the_seed_broadcast_counts_what_is_sent(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "nothing of the kind is here today")], "doc_id long, text string")
    items = spark.createDataFrame([(k, "one two three four five six") for k in range(40)], "item_id long, text string")
    for most in (2, 79, 160, 1_000_000):
        assert sorted(r.item_id for r in tiling.contaminated(docs, items, max_filter=most).collect()) == list(range(40))
