"""Queries of the edit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import edits as O
from .query_joins import clips_of
from .registry import query


@query("edt1_apply_line_edits", """
    WITH a AS (SELECT l.line_id, l.source, l.refined, max(CASE WHEN n = 0 THEN text END) AS t0, max(CASE WHEN n = 1 THEN text END) AS t1, max(CASE WHEN n = 2 THEN text END) AS t2 FROM lines l JOIN edits e USING (line_id) GROUP BY ALL)
    SELECT line_id, t2 AS source, CASE WHEN t0 = t1 THEN source END AS orig_source, true AS refined FROM a UNION ALL SELECT line_id, source, NULL, refined FROM lines WHERE speaker <> 'S1'""")
def edt1(lines, edits):
    return O.apply_line_edits(lines, edits).select("line_id", "source", "orig_source", "refined")


@query("edt2_revisions", "SELECT s.session_id, s.lines_rev + count(e.n) AS lines_rev FROM sessions s LEFT JOIN edits e USING (session_id) GROUP BY s.session_id, s.lines_rev")
def edt2(edits, sessions):
    return O.revisions(edits, sessions)


@query("edt2_stale_summaries", "SELECT session_id, lines_rev <> 1 AS stale FROM sessions")
def edt2b(sessions):
    summaries = sessions.select("session_id", F.lit(1).alias("lines_rev"))
    return O.stale_summaries(summaries, sessions).select("session_id", "stale")


@query("edt3_replace_transcript", """
    WITH h AS (SELECT line_id, session_id, start, end_time FROM lines WHERE line_id % 5 = 0 AND lang = 'zh'), n AS (SELECT line_id + 500 AS line_id, session_id, start + 0.25 AS start, end_time + 0.25 AS end_time, upper(source) AS source FROM lines WHERE lang = 'zh'),
    p AS (SELECT h.line_id AS edit_id, n.line_id, h.start, n.start AS ns, least(h.end_time, n.end_time) - greatest(h.start, n.start) AS o, h.end_time - h.start AS own, n.end_time - n.start AS len FROM h JOIN n USING (session_id)),
    b AS (SELECT * FROM p WHERE o > 0 AND o / own >= 0.6 AND len / own <= 1.6 QUALIFY row_number() OVER (PARTITION BY edit_id ORDER BY o DESC, ns, line_id) = 1),
    c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY start DESC, edit_id DESC) = 1)
    SELECT line_id, CASE WHEN c.edit_id IS NOT NULL THEN concat(l.source, '!') ELSE n.source END AS source, c.edit_id IS NOT NULL AS hand FROM n LEFT JOIN c USING (line_id) LEFT JOIN lines l ON l.line_id = c.edit_id
    UNION ALL SELECT line_id, CASE WHEN line_id % 5 = 0 THEN concat(source, '!') ELSE source END, line_id % 5 = 0 FROM lines WHERE lang <> 'zh'""")
def edt3(lines, voiceprints):
    hand = F.col("line_id") % 5 == 0
    old = lines.withColumn("orig_source", F.when(hand, F.col("source"))).withColumn("source", F.when(hand, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    new = lines.where("lang = 'zh'").withColumn("line_id", F.col("line_id") + 500).withColumn("start", F.col("start") + 0.25).withColumn("end_time", F.col("end_time") + 0.25).withColumn("source", T.upper_by_character(F.col("source")))
    return O.replace_transcript(old, new, voiceprints)[0].select("line_id", "source", F.col("orig_source").isNotNull().alias("hand"))


@query("edt4_merge_speakers", "SELECT line_id, CASE WHEN speaker = 'S2' AND session_id % 2 = 0 THEN 'S1' ELSE speaker END AS speaker FROM lines")
def edt4(lines, speaker_names, voiceprints):
    mapping = lines.where("speaker = 'S2' AND session_id % 2 = 0").select("session_id", F.col("speaker").alias("code"), F.lit("S1").alias("into")).distinct()
    return O.merge_speakers(lines, speaker_names, voiceprints, mapping)[0].select("line_id", "speaker")


@query("edt5_rename_speaker", "SELECT session_id, code, CASE name WHEN 'N1' THEN 'Ann' ELSE name END AS name FROM speaker_names")
def edt5(speaker_names, lines):
    renames = lines.sparkSession.createDataFrame([("N1", "Ann"), ("N2", "N3"), ("X", "Y")], "old string, new string")
    return O.rename_speaker(speaker_names, renames)[0].select("session_id", "code", "name")


@query("edt6_forget_and_delete", "SELECT vec_id FROM known_prints WHERE name <> 'N3' UNION ALL SELECT line_id FROM lines WHERE session_id % 5 <> 2")
def edt6(known_prints, lines, sessions):
    (kept,) = O.forget("N3", known_prints)
    (left,) = O.delete_sessions(sessions.where("session_id % 5 = 2"), lines)
    return kept.select("vec_id").union(left.select("line_id"))


@query("edt7_upsert_terms", """
    WITH n AS (SELECT id AS seq, source, CASE WHEN id % 9 = 0 THEN 'de' ELSE 'en' END AS lang, CASE WHEN id % 5 = 0 THEN 'odd' ELSE 'keep' END AS mode FROM terms)
    SELECT source, lang, mode FROM (SELECT -1 AS seq, source, lang, mode FROM terms UNION ALL SELECT * FROM n WHERE mode <> 'odd') x QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY seq DESC, mode) = 1""")
def edt7(terms):
    new = terms.select(F.col("id").alias("seq"), "source", F.when(F.col("id") % 9 == 0, "de").otherwise("en").alias("lang"), F.when(F.col("id") % 5 == 0, "odd").otherwise("keep").alias("mode"))
    return O.upsert_terms(terms, new)


@query("edt8_clip_undo")
def edt8(speaker_names, known_prints, voiceprints):
    clips = clips_of(speaker_names, known_prints)
    undo = clips.where("session_id % 7 = 3")
    left, prints, names = O.clip_undo(clips, known_prints.withColumnRenamed("vec_id", "print_id"), speaker_names, voiceprints, undo)
    return left.select("name", "session_id").union(names.select("name", "session_id")).distinct()


@query("edt9_upsert_latest", "SELECT session_id, code, CASE WHEN session_id % 3 = 0 THEN concat('M', CAST((session_id * 1000 + 999) % 10 AS VARCHAR)) ELSE name END AS name FROM speaker_names")
def edt9(speaker_names):
    changes = speaker_names.where("session_id % 3 = 0").select("session_id", "code", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    value = F.when(F.col("seq") == 2, F.concat(F.lit("M"), ((F.col("session_id") * 1000 + 999) % 10).cast("string"))).otherwise("old")
    return O.upsert_latest(speaker_names, changes.withColumn("name", value), ["session_id", "code"])


@query("edt10_accept_candidates", "SELECT source, lang, mode FROM terms QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY mode) = 1 UNION ALL SELECT DISTINCT concat(lower(source), 'x'), 'en', 'hint' FROM terms WHERE id % 4 = 1")
def edt10(terms):
    c = terms.select(F.when(F.col("id") % 4 == 1, F.concat(F.lower("source"), F.lit("x"))).otherwise(F.col("source")).alias("source"), "lang")
    return O.accept_candidates(terms, c)
