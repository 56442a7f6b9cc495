"""Lines that come late over micro-batches, and state that goes when its key falls silent."""

import os
import time

from lectern.streaming import live


def feed(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    os.makedirs(f"{folder}/in", exist_ok=True)
    part = next(f for f in os.listdir(f"{folder}/tmp-{name}") if f.endswith(".parquet"))
    os.rename(f"{folder}/tmp-{name}/{part}", f"{folder}/in/{name}.parquet")
    time.sleep(0.05)


DETECTIONS = "session_id long, speaker string, seq long, lang string"


def test_late_lines_go_before_those_that_came_first(spark, tmp_path):
    rows = [(k % 2, "S1", k, ["zh", "vi", "en"][k // 7 % 3]) for k in range(60)]
    batches = [[r for r in rows if r[2] < 30 and r[2] % 5], [r for r in rows if (r[2] < 30 and r[2] % 5 == 0) or 30 <= r[2] < 45], [r for r in rows if r[2] >= 45], [(0, "S1", 1000, ""), (1, "S1", 1001, "")]]
    for k, b in enumerate(batches):
        feed(spark, tmp_path, f"b{k}", b, DETECTIONS)
    stream = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.track_language(stream, late=40).writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("late").collect())
    whole = spark.createDataFrame(rows, DETECTIONS)
    assert got == sorted(tuple(r) for r in live.track_language(whole).collect()) and len(got) == 60
    # Without the watermark each batch is stepped as it comes, and nothing is lost either.
    q = live.track_language(stream).writeStream.format("memory").queryName("asis").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    asis = sorted(tuple(r) for r in spark.table("asis").collect() if r.seq < 1000)
    assert len(asis) == 60 and asis != got


VOICES = "session_id long, seq long, channel string, seconds double, embedding array<double>"


def until(spark, table, n, seconds=60):
    end = time.time() + seconds
    while time.time() < end and spark.table(table).count() < n:
        time.sleep(0.3)
    return {r.seq: r.code for r in spark.table(table).collect()}


def test_a_silent_session_gives_what_waits_and_its_state_goes(spark, tmp_path):
    feed(spark, tmp_path, "a", [(1, 1, "mic", 2.0, [1.0, 0.0]), (1, 2, "mic", 2.0, [0.0, 1.0]), (1, 30, "mic", 2.0, [-1.0, 0.0])], VOICES)
    stream = spark.readStream.schema(VOICES).parquet(f"{tmp_path}/in")
    q = live.assign_online(stream, late=10, idle=2.0).writeStream.format("memory").queryName("voices").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        # The third waits for the watermark; then its session is silent and it comes out.
        assert until(spark, "voices", 3) == {1: "S1", 2: "S2", 30: "S3"}
        # The session's voices are gone with its state: numbering starts anew.
        feed(spark, tmp_path, "b", [(1, 40, "mic", 2.0, [0.0, 1.0]), (1, 60, "mic", 2.0, [0.0, 1.0])], VOICES)
        assert until(spark, "voices", 5) == {1: "S1", 2: "S2", 30: "S3", 40: "S1", 60: "S1"}
    finally:
        q.stop()
