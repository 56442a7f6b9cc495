"""Forms that hold at size: against plain versions on short inputs, then on long ones."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import correction as C
from lectern.operators import aggs, evaluate, filters, tops, windows


def matrix_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def matrix_diff(a, b):
    """Common ends, then the walk through the whole matrix of longest common subsequences; deletions go first."""
    head = len([1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False))])
    tail = len([1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a[head:][::-1], b[head:][::-1], strict=False))])
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, j in itertools.product(range(len(x) - 1, -1, -1), range(len(y) - 1, -1, -1)):
        best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [("same", c) for c in a[:head]], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out, i, j = [*out, ("same", x[i])], i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out, i = [*out, ("del", x[i])], i + 1
        else:
            out, j = [*out, ("add", y[j])], j + 1
    out += [("same", c) for c in a[len(a) - tail :]]
    return [(k, "".join(t for _, t in g)) for k, g in itertools.groupby(out, key=lambda p: p[0])]


def test_distances_and_diffs_equal_the_matrix():
    draw = random.Random(1)
    for _ in range(600):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randint(0, 14))) for _ in range(2))
        assert C.distance(a, b) == matrix_distance(a, b)
        assert C.distance(list(a), list(b)) == matrix_distance(a, b)
        assert C.char_diff(a, b) == matrix_diff(a, b)


def test_distances_and_diffs_of_long_texts_take_seconds():
    draw, began = random.Random(2), time.time()
    a = "".join(draw.choice("abcdefgh ") for _ in range(20_000))
    b = "".join(c if draw.random() > 0.1 else draw.choice("xyz") for c in a[::1])
    assert 1500 < C.distance(a, b) < 2500
    parts = C.char_diff(a, b)
    assert "".join(t for k, t in parts if k != "add") == a and "".join(t for k, t in parts if k != "del") == b
    assert time.time() - began < 30


def test_assignment_equals_all_maps_and_takes_many_labels():
    draw = random.Random(3)
    for _ in range(200):
        n, m = draw.randint(1, 5), draw.randint(1, 6)
        w = [[draw.choice([0, 0, 1, 5, draw.randint(0, 50)]) for _ in range(m)] for _ in range(n)]
        wide = w if n <= m else [list(c) for c in zip(*w, strict=True)]
        want = max(sum(row[c] for row, c in zip(wide, chosen, strict=True)) for chosen in itertools.permutations(range(len(wide[0])), len(wide)))
        assert evaluate.best_assignment(w) == want
    big = [[draw.randint(0, 99) for _ in range(7)] for _ in range(50)]
    # Seven labels: the best sum by subsets of the columns, a row at a time.
    best = {0: 0}
    for row in big:
        for mask, v in list(best.items()):
            for c in range(7):
                if not mask >> c & 1:
                    best[mask | 1 << c] = max(best.get(mask | 1 << c, 0), v + row[c])
    assert evaluate.best_assignment(big) == max(best.values())


def test_fifty_speakers_of_the_reference_are_mapped(spark):
    rows = [(1, k, float(k * 10), f"S{k % 50}", "x" * (1 + k % 7)) for k in range(400)]
    ref = spark.createDataFrame(rows, "session_id long, line_id long, start double, speaker string, source string")
    hyp = ref.withColumn("speaker", F.concat(F.lit("H"), (F.col("line_id") % 50 % 6).cast("string")))
    got = evaluate.speaker_error(ref, hyp).collect()[0]
    cell = {}
    for _, k, _, r, s in rows:
        cell[r, k % 50 % 6] = cell.get((r, k % 50 % 6), 0) + len(s)
    # Each hypothesis label takes its heaviest reference label; these never clash.
    hit = sum(max(v for (_, h), v in cell.items() if h == one) for one in range(6))
    assert (got.error, got.ref_speakers, got.hyp_speakers) == (round(1 - hit / sum(cell.values()), 4), 50, 6)


@pytest.mark.parametrize("line,bad", [("請不吝點贊 訂閱", True), ("中文字幕提供", True), ("會議紀錄的中文字幕要不要做", False), ("本集就這樣結束了", True), ("本集團的專案結束了", False), ("多謝您的觀看", True), ("感謝大家的努力", False), ("剪輯·王小明", True), ("影片剪輯外包", False), ("下次再見", True), ("我們下次見面再談", False), ("ĐĂNG KÝ KÊNH nhé", True), ("Thank you.", True), ("Thank you for the report", False), ("請您 關注", True), ("see you next time!", True)])
def test_default_boilerplate(spark, line, bad):
    assert spark.range(1).select(filters.is_boilerplate(F.lit(line)).alias("b")).first().b is bad


def test_default_fillers_are_counted(spark):
    df = spark.createDataFrame([("A", 1, "那個其實就是這樣子啦 OK"), ("A", 1, "當然可能")], "name string, session_id long, text string")
    got = {r.feature: r.n for r in aggs.wording_profile(df).collect() if r.feature.startswith("F:")}
    assert got == {f"F:{w}": 1 for w in ("那個", "其實", "就是", "這樣子", "啦", "OK", "當然", "可能")}


def test_a_meeting_of_many_lines_is_cut_in_linear_time(spark):
    lines = spark.range(200_000).selectExpr("1L AS session_id", "id AS line_id", "CAST(id AS DOUBLE) AS start", "CAST(id + 1 AS DOUBLE) AS end_time", "'S1' AS speaker", "'en' AS lang", "'ok' AS status", "false AS refined", "'word' AS source")
    began = time.time()
    got = windows.candidate_runs(lines, seconds=60.0, chars=20).groupBy("run").agg(F.count("*").alias("n")).groupBy("n").count().collect()
    assert [tuple(r) for r in got] == [(5, 40_000)] and time.time() - began < 60


def test_picks_need_no_global_window(spark):
    hits = spark.createDataFrame([(k, k % 3) for k in range(1, 40)], "session_id long, hits long")
    index = spark.createDataFrame([(k, None if k == 7 else 1000 - k % 11) for k in range(5, 60)], "session_id long, started long")
    got = tops.pick_sessions(hits, index, 25)
    place = {k: n for n, (k, _) in enumerate(sorted(((k, None if k == 7 else 1000 - k % 11) for k in range(5, 60)), key=lambda r: (r[1] is None, -(r[1] or 0), -r[0])))}
    every = [(k, k % 3) for k in range(1, 40)] + [(k, 0) for k in range(40, 60)]
    assert [tuple(r) for r in got.collect()] == sorted(every, key=lambda r: (-r[1], place.get(r[0], 10**9), -r[0]))[:25]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
