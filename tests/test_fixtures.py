"""Semantics on small rows made for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import correction as C
from lectern.functions import text as T
from lectern.operators import aggs, audits, correct, evaluate, filters, joins, voices, windows
from lectern.sources import transcripts
from lectern.streaming import live

#: Readings of the characters used here (fixed values): character, without tone, with tone.
READINGS = [("工", "gong", "gong1"), ("公", "gong", "gong1"), ("單", "dan", "dan1"), ("生", "sheng", "sheng1"), ("升", "sheng", "sheng1"), ("管", "guan", "guan3"), ("館", "guan", "guan3"), ("官", "guan", "guan1"), ("的", "de", "de1"), ("理", "li", "li3"), ("事", "shi", "shi4")]


def test_changed_terms_look_like_words():
    assert C.changed_terms("確認料耗的數量", "確認料號的數量") == [("料耗", "料號")]
    assert C.changed_terms("有的問題", "有裂痕問題") == []
    assert C.changed_terms("報", "，報") == []
    assert C.changed_terms("我說內銷", "我說内销", script=("内销", "內銷")) == []


def test_char_diff():
    assert C.char_diff("abcd", "abXd") == [("same", "ab"), ("del", "c"), ("add", "X"), ("same", "d")]
    assert C.char_diff("", "a") == [("add", "a")] and C.char_diff("a", "a") == [("same", "a")]


def test_learned_pairs_cancel_their_inverse(spark):
    rows = [(1, "aa", "bb", "zh"), (2, "aa", "bb", "zh"), (3, "cc", "dd", "zh"), (4, "dd", "cc", "zh"), (5, "ee", "ee", "zh"), (6, " ff ", "gg", "en")]
    got = correct.learn_corrections(spark.createDataFrame(rows, "seq long, wrong string, right string, lang string")).collect()
    assert {(r.wrong, r["right"], r["count"]) for r in got} == {("aa", "bb", 2), ("ff", "gg", 1)}


LINES = "line_id long, session_id long, start double, end_time double, speaker string, lang string, source string, status string, refined boolean"


def lines_of(spark, *rows):
    full = [(k, 1, float(a), None if b is None else float(b), *(tuple(more) + ("S1", "zh", "x", "ok", False)[len(more) :])) for k, (a, b, *more) in enumerate(rows)]
    return spark.createDataFrame(full, LINES)


def test_fragments_merge_and_real_breaks_do_not(spark):
    one = lines_of(spark, (0, 2, "S1", "zh", "我們今天要討論的是"), (2.3, 4, "S1", "zh", "交期的問題"), (4.5, 5, "S1", "zh", "還有產能"))
    assert windows.merge_fragments(one).count() == 3
    joined = windows.join_lines(windows.merge_fragments(one)).first()
    assert (joined.source, joined.end_time) == ("我們今天要討論的是交期的問題還有產能", 5.0)
    for second in [(3.1, 4), (2.3, 4, "S2"), (2.3, None), (2.3, 4, "S1", "en"), (2.3, 4, "S1", "zh", "x", "asr_failed"), (2.3, 4, "S1", "zh", "x", "ok", True)]:
        assert windows.merge_fragments(lines_of(spark, (0, 2), second)).count() == 0, second
    assert windows.merge_fragments(lines_of(spark, (0, 2, "S1", "zh", "完了。"), (2.3, 4))).count() == 0
    assert windows.candidate_runs(lines_of(spark, (0, 2, "S1", "zh", "完了。"), (2.3, 4))).count() == 2
    blocked = spark.createDataFrame([(1, 1)], "session_id long, line_id long")
    assert windows.merge_fragments(lines_of(spark, (0, 2), (2.3, 4)), blocked).count() == 0
    long_ = lines_of(spark, *[(k * 9, k * 9 + 8.5) for k in range(6)])
    assert sorted(r["count"] for r in windows.merge_fragments(long_).groupBy("run").count().collect()) == [3, 3]


def ballots(spark, *groups):
    rows, seq = [], 0
    for speaker, lang, n, decode in groups:
        for _ in range(n):
            rows.append((1, speaker, lang, "x", decode, seq))
            seq += 1
    return spark.createDataFrame(rows, "session_id long, speaker string, lang string, text string, decode long, seq long")


def test_language_votes(spark):
    got = lambda *g: {r.speaker: r.lang for r in aggs.dominant_languages(ballots(spark, *g)).collect()}
    assert got(("S1", "zh", 20, -1), ("S2", "en", 6, -1), ("S3", "en", 2, -1)) == {"S1": "zh", "S2": "en", "S3": "zh"}
    assert got(("S1", "zh", 570, -1), ("S2", "en", 5, -1), ("S3", "en", 9, -1)) == {"S1": "zh", "S2": "zh", "S3": "zh"}
    batched = [("S1", "zh", 60, d) for d in range(12)] + [("S1", "en", 64, 99)]
    assert got(*batched) == {"S1": "zh"}


def test_clustering(spark):
    rows = [(1, 1, [1.0, 0.35, 0.0]), (1, 2, [0.35, 1.0, 0.0]), (1, 3, [2.0, 0.7, 0.0]), (1, 4, [0.7, 2.0, 0.0]), (2, 5, [1.0, 0.35, 0.0])]
    got = voices.cluster_voices(spark.createDataFrame(rows, "session_id long, item long, centroid array<double>"), 0.75).collect()
    assert {r.item: r.label for r in got} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_clustering_of_a_long_meeting_keeps_its_voices():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(5, 192))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = [(base[k % 5] + 0.3 * rng.normal(size=192) / np.sqrt(192)).tolist() for k in range(600)]
    label = voices.complete_linkage(vectors, 0.65)
    assert len(set(label)) == 5 and all(label[k] == label[k % 5] for k in range(600))


def test_prints_are_kept_apart_and_capped(spark):
    eye = np.eye(10).tolist()
    rows = [(k, "Ann", eye[k]) for k in range(9)] + [(9, "Ann", [1.0, 0.01] + [0.0] * 8)]
    df = spark.createDataFrame(rows, "seq long, name string, centroid array<double>")
    kept = [r.centroid for r in voices.remember_voices(df).collect()]
    assert len(kept) == 8
    online = {r.seq: (r.learned, r.held) for r in live.remember_online(df).collect()}
    assert online[7] == (True, 8) and online[8] == (True, 8)


def test_utterances_are_cut_where_the_voice_changes(spark):
    turns = spark.createDataFrame([(1, 0.0, 4.0, 0), (1, 4.0, 10.0, 1), (2, 0.0, 5.0, 0), (2, 2.0, 2.2, 1), (2, 5.0, 8.0, 0)], "session_id long, start double, end_time double, speaker int")
    utts = spark.createDataFrame([(1, 1, 0.0, 10.0), (2, 2, 0.0, 8.0), (3, 3, 0.0, 1.0)], "session_id long, line_id long, start double, end_time double")
    got = sorted(tuple(r) for r in evaluate.split_on_turns(utts, turns).collect())
    assert got == [(1, 1, 0, 0.0, 4.0, 0), (1, 1, 1, 4.0, 10.0, 1), (2, 2, 0, 0.0, 8.0, 0), (3, 3, 0, 0.0, 1.0, -1)]


def test_hand_edits_are_carried_by_time(spark):
    edits = spark.createDataFrame([(1, 1, 10.0, 12.0)], "edit_id long, session_id long, start double, end_time double")
    new = lambda a, b: spark.createDataFrame([(7, 1, a, b)], "line_id long, session_id long, start double, end_time double")
    assert joins.restore_edits(edits, new(10.2, 12.1)).count() == 1
    assert joins.restore_edits(edits, new(5.0, 45.0)).count() == 0


def test_evaluation(spark):
    ref = lines_of(spark, (0, 1, "S1", "zh", "確認料號的數量"), (10, 11, "S2", "vi", "toi dong y"))
    hyp = lines_of(spark, (0, 1, "S1", "zh", "確認料耗的數量"), (10, 11, "S1", "vi", "toi khong y"))
    assert {(r.lang, r.metric, r.errors, r.total) for r in evaluate.error_rate(ref, hyp).collect()} == {("zh", "cer", 1, 7), ("vi", "wer", 1, 3)}
    e = evaluate.speaker_error(ref, hyp).first()
    assert (e.ref_speakers, e.hyp_speakers) == (2, 1) and 0 < e.error < 1


def test_guards(spark):
    terms = spark.createDataFrame([(1, "工單", "hint")], "id long, source string, mode string")
    readings = F.create_map(*(F.lit(x) for c, a, _ in READINGS for x in (c, a)))
    rows = [("公單的管理", "工單的管理", True), ("公單的管理", "公單 的管理", False), ("公單的管理", "", False), ("公單的管理", "完全不同的話", False), ("生館的事", "生管的事", True)]
    got = audits.accept(spark.createDataFrame([r[:2] for r in rows], "original string, candidate string"), terms, lambda c: T.sound_key(c, readings)).collect()
    assert {(r.original, r.candidate): r.accepted for r in got} == {r[:2]: r[2] for r in rows}


def test_transcript_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("[0:10] S2 (vi) toi dong y\nnoise\n---\n[1:05] S1 (zh) 好\n")
    got = transcripts.read_transcripts(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.start, r.speaker, r.lang, r.text) for r in got] == [(10.0, "S2", "vi", "toi dong y"), (65.0, "S1", "zh", "好")]
    assert transcripts.read_transcripts(spark, str(tmp_path), after_marker=True).count() == 1


def test_screen_order(spark):
    rows = [(1, 1, 1, 5.0, "a"), (1, 2, 2, 9.0, "b"), (1, 3, 3, 7.0, "late"), (1, 1, 4, 8.0, "a2"), (1, 4, 5, 9.0, "c")]
    df = spark.createDataFrame(rows, "session_id long, id long, seq long, start double, source string")
    screen = live.merge_lines(df).orderBy("order_key", "first_seq").collect()
    assert [r.source for r in screen] == ["a2", "late", "b", "c"]
    assert {r.source for r in live.merge_lines(df, 2).collect()} == {"b", "c"}


def test_a_stream_and_its_batch_twin_agree(spark, tmp_path):
    rows = [(1, f"S{k % 2}", k, "zh" if k % 7 < 4 else "en") for k in range(60)]
    df = spark.createDataFrame(rows, "session_id long, speaker string, seq long, lang string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.track_language(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = sorted(tuple(r) for r in spark.table("tracked").collect())
    assert got == sorted(tuple(r) for r in live.track_language(df).collect()) and len(got) == 60


def test_online_speakers_stay_in_their_channel(spark):
    rows = [(1, 1, "a", 2.0, [1.0, 0.0]), (1, 2, "b", 2.0, [1.0, 0.0]), (1, 3, "a", 2.0, [0.9, 0.1]), (1, 4, "a", 0.5, [0.0, 1.0]), (1, 5, "a", 2.0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "session_id long, seq long, channel string, seconds double, embedding array<double>")
    got = {r.seq: (r.code, r.name) for r in live.assign_online(df, [("Ann", [1.0, 0.0])]).collect()}
    assert got == {1: ("S1", "Ann"), 2: ("S2", "Ann"), 3: ("S1", "Ann"), 4: ("S1", "Ann"), 5: ("S3", "")}


def test_held_utterances_get_one_more_try(spark):
    rows = [(1, 1, "fail", "S1", 10, "zh"), (1, 2, "fail", "S2", 11, "zh"), (1, 3, "language", "S1", 0, "zh"), (1, 4, "language", "S1", 0, "en"), (1, 5, "end", "", 0, "")]
    df = spark.createDataFrame(rows, "session_id long, seq long, kind string, speaker string, item long, lang string")
    assert [(r.item, r.action) for r in live.retry_buffer(df).collect()] == [(10, "retry"), (11, "dropped")]
    many = spark.createDataFrame([(1, k, "fail", "S1", k, "zh") for k in range(26)], df.schema)
    assert [(r.item, r.action) for r in live.retry_buffer(many).collect()] == [(0, "dropped"), (1, "dropped")]


def test_search_needs_keywords(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, "100% DONE_x"), (2, 2, 0.0, "done")], "line_id long, session_id long, start double, source string")
    sessions = spark.sql("SELECT 1L AS session_id, TIMESTAMP '2024-01-01 10:00:00' AS started UNION ALL SELECT 2L, TIMESTAMP '2024-01-02 23:59:58'")
    found = lambda *a: [r.line_id for r in filters.search_lines(lines, sessions, *a).collect()]
    assert found([" done "]) == [2, 1] and found(["0% d"]) == [1] and found(["x", " "]) == [] and found(["done"], None, "2024-01-01") == [1] and found(["done"], "2024-01-02", "2024-01-02") == [2]


@pytest.mark.parametrize(("text", "noise", "broken"), [("[MUSIC", True, False), ("(static) -", True, False), ("hi (x)", False, False), ("", False, False), ("la la la la la", False, True), ("一一一一一", False, True)])
def test_noise_and_repetition(spark, text, noise, broken):
    r = spark.createDataFrame([(text,)], "t string").select(filters.is_noise(F.col("t")).alias("n"), filters.is_degenerate(F.col("t")).alias("d")).first()
    assert (r.n, r.d) == (noise, broken)


def test_chains_give_the_groups_that_merging_the_best_pair_gives():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40, 90):
        vectors = rng.normal(size=(n, 5))
        u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        groups = [[k] for k in range(n)]
        while len(groups) > 1:
            score, i, j = max((min(u[x] @ u[y] for x in groups[i] for y in groups[j]), i, j) for i in range(len(groups)) for j in range(i))
            if score < 0.4:
                break
            groups[j] = sorted(groups[j] + groups.pop(i))
        assert voices.complete_linkage(vectors.tolist(), 0.4) == [min(g) for k in range(n) for g in groups if k in g]
    assert voices.complete_linkage([], 0.5) == [] and voices.complete_linkage([[1.0], [float("nan")], [2.0]], 0.5) == [0, 1, 0]


def test_short_changes_take_letters_of_their_word():
    assert C.changed_terms("用生館做", "用生管做") == [("館做", "管做")]
    assert C.changed_terms("問生館", "問生管") == [("生館", "生管")]
    assert C.changed_terms("a 館 b", "a 管 b") == []


def test_equal_proposals_count_each(spark):
    judged = spark.createDataFrame([("公單的管理", "工單的管理", True)] * 2 + [("x", "y", False)], "before string, after string, accepted boolean")
    vocabulary = spark.createDataFrame([("公單", 5)], "gram string, n long")
    lines = spark.createDataFrame([("公單公單公單",)], "text string")
    r = correct.score_guards(judged, vocabulary, lines).first()
    assert (r.proposals, r.accepted, r.rejected, r.suspect, r.displaces) == (3, 2, 1, 2, 2)
