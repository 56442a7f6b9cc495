"""Values of operators whose registered queries have no SQL, on rows small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import audits, correct, edits
from lectern.sources import transcripts

LINES = "session_id long, line_id long, start double, end_time double, speaker string, lang string, source string, status string, refined boolean, translations map<string,string>"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(1, 1, 0.0, 2.0, "S1", "zh", "大家好", "ok", False, {"en": "Hello all"}), (1, 2, 2.5, 4.0, "S1", "zh", "開始吧", "ok", False, {}), (1, 3, 65.0, 70.0, "S2", "vi", "tôi đồng ý", "ok", False, {"zh": "我同意", "en": "I agree"})]
    return spark.createDataFrame(rows, LINES)


def test_markdown(spark, lines):
    names = spark.createDataFrame([(1, "S1", "Ann")], "session_id long, code string, name string")
    for stale, status in ((True, "ok"), (False, "ok"), (True, "failed")):
        summary = spark.createDataFrame([(1, "About it", status, stale)], "session_id long, summary string, status string, stale boolean")
        top = "" if status == "failed" else "## Summary\n" + "> The transcript has changed since.\n" * stale + "About it\n\n"
        body = "## Speakers\n- S1: Ann\n- S2: (unnamed)\n\n## Lines\n[0:00] **Ann** 大家好\n  - en: Hello all\n[0:02] **Ann** 開始吧\n[1:05] **S2** tôi đồng ý\n  - en: I agree\n  - zh: 我同意\n"
        assert transcripts.to_markdown(lines, names, summary).first().value == top + body


def test_turn_document(lines):
    # Ten of sixteen characters are S2's; S1's two lines are one turn.
    assert transcripts.turn_document(lines.drop("translations")).first().value == "S2 62%, S1 38%\n\n**S1** 00:00\n大家好 開始吧\n\n**S2** 01:05 (vi)\ntôi đồng ý\n"


def test_mined_terms_and_scores(spark):
    rows = [("確認料耗的數量", "確認料號的數量"), ("那些料耗的數量", "那些料號的數量"), ("料耗多少", "料號多少"), ("工單", "公單"), ("工單", "公單")]
    pairs = spark.createDataFrame(rows, "original string, candidate string")
    known = spark.createDataFrame([("公單",)], "source string")
    sound = lambda c: F.translate(c, "耗號", "hh")
    # Right sides that the glossary has do not count, nor does what was asked for once.
    assert [tuple(r) for r in correct.mine_terms(pairs, known, sound, 2, 0.45).collect()] == [("料耗", "料號", 2, 0.0, True)]
    assert [tuple(r) for r in correct.mine_terms(pairs, known, lambda c: c, 2, 0.5).collect()] == [("料耗", "料號", 2, 0.5, False)]
    assert correct.mine_terms(pairs, known, lambda c: c, 2, 0.45).count() == 0
    seen = spark.createDataFrame([("料耗", 3), ("工單", 2)], "gram string, n long")
    got = correct.score_changes(pairs.select(F.col("original").alias("before"), F.col("candidate").alias("after")), seen)
    assert {tuple(r) for r in got.collect()} == {("suspect", "料耗", "料號", 2), ("fix", "耗多", "號多", 1), ("fix", "工單", "公單", 2)}


def test_guards(spark):
    judged = spark.createDataFrame([("確認料耗的數量", "確認料號的數量", True), ("有工單了", "有公單了", True), ("一", "二", False)], "before string, after string, accepted boolean")
    seen = spark.createDataFrame([("料耗", 3)], "gram string, n long")
    # 料耗 is said three times, more than 料號; 工單 is not said at all.
    corpus = spark.createDataFrame([("料耗料耗",), ("料耗",), ("料號",)], "text string")
    assert tuple(correct.score_guards(judged, seen, corpus).first()) == (3, 2, 1, 1, 1)
    assert tuple(correct.score_guards(judged, seen, corpus.where("text <> '料耗'")).first()) == (3, 2, 1, 1, 0)


def test_prompts_hold_whole_notes_and_the_lines_before(spark):
    rows = spark.createDataFrame([(1, k, float(k), f"line {k} Alpha", "zh") for k in range(1, 6)], "session_id long, line_id long, start double, source string, lang string")
    terms = spark.createDataFrame([(1, "alpha", "keep"), (2, "zeta", "keep"), (3, "line", "hint")], "id long, source string, mode string")
    note = "n" * 3000
    got = {r.chunk: r.prompt for r in audits.prompt_rows(rows, terms, "T:{terms}|C:{context}|N:{note}|L:{lines}", 2, 1, F.lit(note)).collect()}
    assert got == {
        0: f"T:alpha|C:|N:{note}|L:1: line 1 Alpha\n2: line 2 Alpha",
        1: f"T:alpha|C:line 2 Alpha|N:{note}|L:1: line 3 Alpha\n2: line 4 Alpha",
        2: f"T:alpha|C:line 4 Alpha|N:{note}|L:1: line 5 Alpha",
    }


def test_an_undone_sample_takes_its_prints_and_name_along(spark):
    clips = spark.createDataFrame([("Ann", 1), ("Ann", 2), ("Bob", 1)], "name string, session_id long")
    prints = spark.createDataFrame([(1, "Ann", [1.0, 0.0]), (2, "Ann", [0.0, 1.0]), (3, "Bob", [1.0, 0.0])], "print_id long, name string, centroid array<double>")
    names = spark.createDataFrame([(1, "S1", "Ann"), (1, "S2", "Bob"), (2, "S1", "Ann")], "session_id long, code string, name string")
    heard = spark.createDataFrame([(1, "S1", [1.0, 0.05]), (1, "S2", [1.0, 0.0]), (2, "S1", [0.0, 1.0])], "session_id long, code string, centroid array<double>")
    undo = spark.createDataFrame([("Bob", 1)], "name string, session_id long")
    for to, more in ((None, False), ("Cid", True)):
        left, kept, named = edits.clip_undo(clips, prints, names, heard, undo, to)
        assert sorted(map(tuple, left.collect())) == [("Ann", 1), ("Ann", 2)] + [("Cid", 1)] * more
        assert sorted(r.print_id for r in kept.collect()) == [1, 2]
        assert sorted((r.session_id, r.code, r.name) for r in named.collect()) == [(1, "S1", "Ann")] + [(1, "S2", "Cid")] * more + [(2, "S1", "Ann")]
