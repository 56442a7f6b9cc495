"""Queries of voices. The driver's vectors hold no clusters, so thresholds are lower than the operators' own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..operators import voices as O
from .query_aggs import _COS, _FILL
from .query_joins import clips_of
from .registry import query


@query("vox1_cluster_voices")
def vox1(voiceprints):
    return O.cluster_voices(voiceprints.select(F.floor(F.col("vec_id") / 50).alias("session_id"), F.col("vec_id").alias("item"), "centroid"), 0.25)


@query("vox2_regroup_labels")
def vox2(turns, embeddings):
    v = turns.select("session_id", "turn_id", (F.col("turn_id") % 500).alias("vec_id")).join(embeddings.select("vec_id", "embedding"), "vec_id")
    return O.regroup_labels(turns, v, 0.5).groupBy("session_id", "speaker").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end_time") - F.col("start")), 3).alias("seconds"))


@query("vox3_remember_voices")
def vox3(known_prints):
    return O.remember_voices(known_prints.withColumnRenamed("vec_id", "seq"), 0.3, 4).select("name", "place", F.round(F.get("centroid", F.lit(0)).cast("double"), 5).alias("first"))


@query("vox4_unlearn_voice", f"""
    WITH w AS (SELECT concat('N', vec_id % 7) AS name, centroid FROM voiceprints WHERE session_id < 4),
    s AS (SELECT a.vec_id, b.name, b.centroid AS v, {_COS} AS c FROM known_prints a JOIN w b ON a.name = b.name),
    x AS (SELECT vec_id FROM s WHERE c >= 0.15 QUALIFY row_number() OVER (PARTITION BY name, v ORDER BY c DESC, vec_id DESC) = 1)
    SELECT vec_id AS print_id, name FROM known_prints WHERE vec_id NOT IN (SELECT vec_id FROM x)""")
def vox4(known_prints, voiceprints):
    wrong = voiceprints.where("session_id < 4").select(F.concat(F.lit("N"), (F.col("vec_id") % 7).cast("string")).alias("name"), F.col("centroid").alias("vector"))
    return O.unlearn_voice(known_prints.withColumnRenamed("vec_id", "print_id"), wrong, 0.15).select("print_id", "name")


@query("vox5_auto_learn", f"""
    WITH m AS (SELECT a.code, b.name, max({_COS}) AS score FROM voiceprints a CROSS JOIN known_prints b GROUP BY ALL)
    SELECT code, name FROM m WHERE round(score, 6) >= 0.3""")
def vox5(voiceprints, known_prints):
    # What rounds to the bound lies over 0.2999995.
    return O.auto_learn(joins.voice_scores(voiceprints, known_prints, 0.3 - 1e-6).withColumn("score", F.round("score", 6)), 0.3).select("code", "name")


@query("vox6_suggest_names")
def vox6(voiceprints, known_prints, lines, speaker_names):
    named = joins.named_lines(lines, speaker_names)
    prints = voiceprints.select("session_id", F.concat(F.lit("S"), (1 + F.col("vec_id") % 3).cast("string")).alias("code"), "centroid")
    unnamed = lines.select("session_id", F.col("speaker").alias("code"), F.col("source").alias("text"))
    return O.suggest_names(prints, known_prints, named, unnamed, 0.2, 0.05, 2, _FILL).withColumn("score", F.round("score", 5))


@query("vox7_forced_languages", """
    WITH c AS (SELECT DISTINCT session_id, speaker AS code, lang FROM lines), p AS (SELECT session_id, code FROM c WHERE session_id % 11 = 0), k AS (SELECT DISTINCT name FROM known_prints)
    SELECT c.session_id, c.code, CASE WHEN p.code IS NOT NULL THEN 'de' WHEN k.name IS NOT NULL THEN 'fr' ELSE c.lang END AS lang
    FROM c LEFT JOIN p USING (session_id, code) LEFT JOIN speaker_names n ON n.session_id = c.session_id AND n.code = c.code LEFT JOIN k ON k.name = n.name""")
def vox7(lines, speaker_names, known_prints):
    codes = lines.select("session_id", F.col("speaker").alias("code"), "lang").distinct()
    pinned = codes.where("session_id % 11 = 0").select("session_id", "code", F.lit("de").alias("lang"))
    return O.forced_languages(codes, speaker_names, known_prints.withColumn("language", F.lit("fr")), pinned)


def _utts(runs, embeddings):
    return runs.withColumn("vec_id", F.col("line_id") % 500).join(embeddings.select("vec_id", "embedding"), "vec_id")


@query("vox8_refresh_prints")
def vox8(runs, embeddings, speaker_names):
    utts = _utts(runs, embeddings)
    old = O.derived_prints(utts)
    changed = old.where("session_id % 4 = 0").select("session_id", "code")
    after, gone, new = O.refresh_prints(changed, old, utts.where("line_id % 8 <> 0"), speaker_names)
    return after.groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.sum(F.get("centroid", F.lit(0))), 5).alias("s"))


@query("vox9_name_speakers", """
    WITH e AS (SELECT session_id, speaker AS code, CASE WHEN session_id % 6 = 0 THEN '' ELSE 'N99' END AS name FROM (SELECT DISTINCT session_id, speaker FROM lines WHERE session_id % 3 = 0) x)
    SELECT session_id, code, name FROM speaker_names n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = n.session_id AND e.code = n.code) UNION ALL SELECT * FROM e WHERE name <> ''""")
def vox9(lines, speaker_names, voiceprints):
    events = lines.where("session_id % 3 = 0").select(F.col("line_id").alias("seq"), "session_id", F.col("speaker").alias("code"), F.when(F.col("session_id") % 6 == 0, " ").otherwise(" N99").alias("name"))
    return O.name_speakers(events, speaker_names, voiceprints)[0]


@query("vox10_harvest", """
    WITH clips AS (SELECT DISTINCT name, session_id FROM speaker_names WHERE session_id % 3 = 0 UNION SELECT concat('N', vec_id % 15) AS name, vec_id + 5000 AS session_id FROM known_prints),
    d AS (SELECT DISTINCT n.name, n.session_id FROM speaker_names n JOIN lines l ON l.session_id = n.session_id AND l.speaker = n.code WHERE n.session_id % 4 = 1 AND n.name IN (SELECT name FROM known_prints))
    SELECT name, session_id FROM (SELECT * FROM clips UNION SELECT * FROM d) x QUALIFY row_number() OVER (PARTITION BY name ORDER BY session_id DESC) <= 3""")
def vox10(sessions, speaker_names, known_prints, lines):
    return O.harvest(sessions.where("session_id % 4 = 1"), speaker_names, known_prints, lines, clips_of(speaker_names, known_prints), 3)
