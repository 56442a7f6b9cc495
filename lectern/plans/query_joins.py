"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as O
from ..operators import windows as W
from .registry import ORACLE_SQL, QUERIES, query
from .views import view, with_views

_COS = "list_cosine_similarity(CAST({}.centroid AS DOUBLE[]), CAST({}.centroid AS DOUBLE[]))"
_CLIPS = "clips AS (SELECT DISTINCT name, session_id FROM speaker_names WHERE session_id % 3 = 0 UNION SELECT concat('N', vec_id % 15) AS name, vec_id + 5000 AS session_id FROM known_prints)"


def clips_of(speaker_names, known_prints):
    other = known_prints.select(F.concat(F.lit("N"), (F.col("vec_id") % 15).cast("string")).alias("name"), (F.col("vec_id") + 5000).alias("session_id"))
    return speaker_names.where("session_id % 3 = 0").select("name", "session_id").union(other).distinct()


@query("join1_lines_with_translations", "SELECT l.line_id, CASE WHEN count(t.lang) > 0 THEN string_agg(concat(t.lang, '=', t.text), ',' ORDER BY t.lang) END AS texts FROM lines l LEFT JOIN translations t USING (line_id) GROUP BY 1")
def join1(lines, translations):
    found = O.lines_with_translations(lines, translations)
    texts = F.transform(F.array_sort(F.map_entries("translations")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("line_id", F.when(F.size("translations") > 0, F.array_join(texts, ",")).alias("texts"))


@query("join2_terms_with_targets", "SELECT id, source, CASE WHEN id % 2 = 0 THEN concat('fr=', upper(source)) END AS targets FROM terms")
def join2(terms):
    targets = terms.where("id % 2 = 0").select(F.col("id").alias("term_id"), F.lit("fr").alias("lang"), F.upper("source").alias("text"))
    found = O.terms_with_targets(terms, targets)
    return found.select("id", "source", F.when(F.size("targets") > 0, F.concat(F.lit("fr="), F.try_element_at("targets", F.lit("fr")))).alias("targets"))


@query("join3_named_lines", "SELECT line_id, name, source AS text FROM lines l JOIN speaker_names n ON n.session_id = l.session_id AND n.code = l.speaker WHERE trim(name) <> '' AND len(source) > 1")
def join3(lines, speaker_names):
    return O.named_lines(lines, speaker_names).select("line_id", "name", "text")


@query("join4_known_prints", """
    WITH v AS (SELECT * FROM known_prints WHERE name <> 'N3'), f AS (SELECT name, min_by(centroid, vec_id) AS centroid FROM known_prints GROUP BY name),
    u AS (SELECT name, centroid FROM v UNION SELECT name, centroid FROM f WHERE name NOT IN (SELECT name FROM v))
    SELECT name, count(*) AS n, round(sum(CAST(centroid[1] AS DOUBLE)), 5) AS s FROM u GROUP BY name""")
def join4(known_prints):
    found = O.known_prints(known_prints.where("name <> 'N3'"), known_prints.groupBy("name").agg(F.min_by("centroid", "vec_id").alias("centroid")))
    return found.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum(F.get("centroid", F.lit(0)).cast("double")), 5).alias("s"))


@query("join5_known_speakers", f"""
    WITH {_CLIPS} SELECT k.name, (SELECT count(DISTINCT session_id) FROM speaker_names s WHERE s.name = k.name) AS meetings
    FROM (SELECT DISTINCT name FROM known_prints) k WHERE name IN (SELECT name FROM speaker_names) OR name IN (SELECT name FROM clips)""")
def join5(speaker_names, known_prints):
    return O.known_speakers(known_prints, speaker_names, clips_of(speaker_names, known_prints))


@query("join6_speaker_sessions", "SELECT name, count(DISTINCT session_id) AS sessions FROM speaker_names WHERE name IN (SELECT name FROM known_prints) GROUP BY name")
def join6(speaker_names, known_prints):
    return O.speaker_sessions(speaker_names, known_prints)


@query("join7_clip_sources", f"""
    WITH {_CLIPS}, live AS (SELECT DISTINCT n.name, n.session_id FROM speaker_names n JOIN lines l ON l.session_id = n.session_id AND l.speaker = n.code)
    SELECT name, session_id, true AS live FROM live UNION ALL SELECT name, session_id, false FROM (SELECT * FROM clips EXCEPT SELECT * FROM live) x""")
def join7(speaker_names, lines, known_prints):
    return O.clip_sources(speaker_names, lines, clips_of(speaker_names, known_prints))


@query("join8_restore_edits", """
    WITH e AS (SELECT line_id AS edit_id, session_id, start + 0.2 AS start, CASE WHEN line_id % 7 = 0 THEN start + 2.2 ELSE end_time END AS end_time FROM lines),
    p AS (SELECT edit_id, line_id, e.start, n.start AS ns, least(e.end_time, n.end_time) - greatest(e.start, n.start) AS o, greatest(e.end_time - e.start, 0.001) AS own, n.end_time - n.start AS len
          FROM e JOIN lines n ON e.session_id = n.session_id),
    b AS (SELECT * FROM p WHERE o > 0 AND o / own >= 0.6 AND len / own <= 1.6 QUALIFY row_number() OVER (PARTITION BY edit_id ORDER BY o DESC, ns, line_id) = 1)
    SELECT edit_id, line_id FROM b QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY start DESC, edit_id DESC) = 1""")
def join8(lines):
    end = F.when(F.col("line_id") % 7 == 0, F.lit(None)).otherwise(F.col("end_time"))
    edits = lines.select(F.col("line_id").alias("edit_id"), "session_id", (F.col("start") + 0.2).alias("start"), end.alias("end_time"))
    return O.restore_edits(edits, lines)


@query("join9_nearest_line", """
    WITH h AS (SELECT session_id, line_id, floor(start * 1.5 + line_id % 4) AS s FROM lines)
    SELECT session_id, ref_id, hyp_id FROM (SELECT l.session_id, l.line_id AS ref_id, h.line_id AS hyp_id, abs(floor(l.start) - h.s) AS g, h.s FROM lines l JOIN h ON h.session_id = l.session_id) x
    WHERE g < 6 QUALIFY row_number() OVER (PARTITION BY session_id, ref_id ORDER BY g, s, hyp_id) = 1""")
def join9(lines):
    hyp = lines.select("session_id", "line_id", (F.col("start") * 1.5 + F.col("line_id") % 4).alias("start"))
    return O.nearest_line(lines, hyp)


@query("join10_match_voice", f"""
    WITH s AS (SELECT p.session_id, p.code, k.name, max({_COS.format('p', 'k')}) AS score FROM voiceprints p CROSS JOIN known_prints k GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, code ORDER BY score DESC, name) AS n, lead(score) OVER (PARTITION BY session_id, code ORDER BY score DESC, name) AS nxt FROM s)
    SELECT session_id, code, name, round(score, 5) AS score FROM r WHERE n = 1 AND score >= 0.2 AND (nxt IS NULL OR score - nxt >= 0.02)""")
def join10(voiceprints, known_prints):
    return O.match_voice(voiceprints, known_prints, 0.2, 0.02).withColumn("score", F.round("score", 5))


@query("join11_cross_meeting_pairs", f"""
    SELECT a.session_id AS a_session, a.code AS a_code, b.session_id AS b_session, b.code AS b_code, round({_COS.format('a', 'b')}, 5) AS score
    FROM voiceprints a JOIN voiceprints b ON (a.session_id < b.session_id) WHERE {_COS.format('a', 'b')} >= 0.3""")
def join11(voiceprints):
    return O.cross_meeting_pairs(voiceprints, 0.3).withColumn("score", F.round("score", 5))


@query("join12_match_by_duration", """
    WITH s AS (SELECT session_id, CAST(session_id % 97 AS DOUBLE) * 10 AS seconds FROM sessions), c AS (SELECT s.session_id, count(m.media_id) AS candidates, min(m.media_id) AS one FROM s LEFT JOIN media m ON abs(s.seconds - m.seconds) <= 2 GROUP BY 1)
    SELECT session_id, candidates, CASE WHEN candidates = 1 THEN one END AS media_id FROM c""")
def join12(sessions, media):
    return O.match_by_duration(sessions.withColumn("seconds", (F.col("session_id") % 97).cast("double") * 10), media)


@query("join13_dominant_speaker", """
    WITH s AS (SELECT session_id % 10 AS session_id, line_id AS span_id, CAST(session_id AS DOUBLE) * 8 + start AS start, CAST(session_id AS DOUBLE) * 8 + end_time AS end_time FROM lines)
    SELECT s.session_id, s.span_id, coalesce(x.speaker, -1) AS speaker FROM s LEFT JOIN (
      SELECT s.span_id, t.speaker FROM s JOIN turns t ON t.session_id = s.session_id AND t.start < s.end_time AND t.end_time > s.start
      QUALIFY row_number() OVER (PARTITION BY s.span_id ORDER BY least(s.end_time, t.end_time) - greatest(s.start, t.start) DESC, t.start DESC, t.speaker DESC) = 1) x USING (span_id)""")
def join13(lines, turns):
    at = F.col("session_id").cast("double") * 8
    spans = lines.select((F.col("session_id") % 10).alias("session_id"), F.col("line_id").alias("span_id"), (at + F.col("start")).alias("start"), (at + F.col("end_time")).alias("end_time"))
    return O.dominant_speaker(spans, turns)


@query("join15_midpoint_assign", """
    SELECT session_id, span_id, string_agg(text, '' ORDER BY start, segment_id) AS text FROM (
      SELECT g.session_id, l.line_id AS span_id, g.start, g.segment_id, g.text FROM segments g JOIN lines l ON l.session_id = g.session_id AND (g.start + g.end_time) / 2 BETWEEN l.start AND l.end_time
      QUALIFY row_number() OVER (PARTITION BY g.session_id, g.segment_id ORDER BY l.start, l.line_id) = 1) x GROUP BY ALL""")
def join15(segments, lines):
    return O.midpoint_assign(segments, lines.withColumnRenamed("line_id", "span_id"))


@query("join16_interrupted", """
    SELECT p.session_id, p.pair_id FROM (SELECT session_id % 10 AS session_id, line_id AS pair_id, CAST(line_id % 4 AS INT) AS speaker, CAST(line_id % 500 AS DOUBLE) AS a, CAST(line_id % 500 AS DOUBLE) + 1.5 AS b FROM lines) p
    WHERE EXISTS (SELECT 1 FROM turns t WHERE t.session_id = p.session_id AND t.speaker <> p.speaker AND t.value >= 0 AND least(t.end_time, b) - greatest(t.start, a) >= 0.5)""".replace(" AND t.value >= 0", ""))
def join16(lines, turns):
    at = (F.col("line_id") % 500).cast("double")
    pairs = lines.select((F.col("session_id") % 10).alias("session_id"), F.col("line_id").alias("pair_id"), (F.col("line_id") % 4).cast("int").alias("speaker"), at.alias("gap_start"), (at + 1.5).alias("gap_end"))
    return O.interrupted(pairs, turns).select("session_id", "pair_id")


@query("join17_stale_prints", "SELECT session_id, code FROM (SELECT session_id, concat('S', CAST(1 + vec_id % 3 AS VARCHAR)) AS code, vec_id FROM voiceprints) p WHERE EXISTS (SELECT 1 FROM lines l WHERE l.session_id = p.session_id AND l.speaker = p.code)")
def join17(voiceprints, lines):
    prints = voiceprints.select("session_id", F.concat(F.lit("S"), (1 + F.col("vec_id") % 3).cast("string")).alias("code"))
    return O.stale_prints(prints, lines).select("session_id", "code")


@query("join18_verify_citations", """
    WITH c AS (SELECT event_id % 997 AS answer_id, event_id * 7 AS line_id FROM events)
    SELECT answer_id, count(l.line_id) AS kept, count(*) - count(l.line_id) AS dropped, count(l.line_id) > 0 AS verified FROM (SELECT DISTINCT * FROM c) c LEFT JOIN lines l USING (line_id) GROUP BY 1""")
def join18(events, lines):
    return O.verify_citations(events.select((F.col("event_id") % 997).alias("answer_id"), (F.col("event_id") * 7).alias("line_id")), lines)[1]


@query("join19_quietest_window", """
    WITH s AS (SELECT session_id % 10 AS session_id, line_id AS span_id, CAST(line_id % 4 AS INT) AS speaker, CAST(line_id % 500 AS DOUBLE) AS a, CAST(line_id % 500 AS DOUBLE) + 12 AS e FROM lines),
    f AS (SELECT s.session_id, span_id, t.start, t.end_time FROM s JOIN turns t ON t.session_id = s.session_id AND t.speaker <> s.speaker AND t.start < s.e AND t.end_time > s.a),
    c AS (SELECT DISTINCT session_id, span_id, a, e, least(greatest(x, a), greatest(a, e - 4)) AS t0 FROM (
       SELECT session_id, span_id, a, e, unnest([a, (a + e - 4) / 2, e - 4]) AS x FROM s UNION ALL
       SELECT s.session_id, span_id, a, e, unnest([f.end_time, f.start - 4]) AS x FROM s JOIN f USING (session_id, span_id)) y),
    o AS (SELECT c.session_id, c.span_id, c.t0, c.a, c.e, round(coalesce(sum(greatest(0, least(least(c.t0 + 4, c.e), f.end_time) - greatest(c.t0, f.start))), 0), 3) AS "foreign" FROM c LEFT JOIN f USING (session_id, span_id) GROUP BY 1, 2, 3, 4, 5)
    SELECT session_id, span_id, t0 AS start, "foreign" FROM o QUALIFY row_number() OVER (PARTITION BY session_id, span_id ORDER BY "foreign", round(abs(t0 + 2 - (a + e) / 2), 6), t0) = 1""")
def join19(lines, turns):
    at = (F.col("line_id") % 500).cast("double")
    spans = lines.select((F.col("session_id") % 10).alias("session_id"), F.col("line_id").alias("span_id"), (F.col("line_id") % 4).cast("int").alias("speaker"), at.alias("start"), (at + 12).alias("end_time"))
    return O.quietest_window(spans, turns, 4.0)


@query("join20_resolve_names", "SELECT line_id, coalesce(n.name, speaker) AS who FROM lines l LEFT JOIN speaker_names n ON n.session_id = l.session_id AND n.code = l.speaker")
def join20(lines, speaker_names):
    return O.resolve_names(lines, speaker_names).select("line_id", "who")


def join21(lines, speaker_names, known_prints):
    known = known_prints.select("name", F.lit("en").alias("language"), F.concat(F.lit("D"), F.substring("name", 2, 1)).alias("department")).distinct()
    found = O.known_speaker_list(known, speaker_names, clips_of(speaker_names, known_prints), W.speaker_samples(lines))
    n = F.aggregate("samples", F.lit(0), lambda a, x: a + F.when(x["start"].isNotNull(), 1).otherwise(0))
    return found.select("name", "meetings", "language", "department", F.size("samples").alias("n_samples"), n.alias("n_live"))


query("join21_known_speaker_list", f"""
    WITH {_CLIPS}, k AS (SELECT DISTINCT name, 'en' AS language, concat('D', substr(name, 2, 1)) AS department FROM known_prints WHERE name IN (SELECT name FROM speaker_names) OR name IN (SELECT name FROM clips)),
    p AS (SELECT name, session_id, code, true AS live FROM speaker_names UNION ALL SELECT name, session_id, NULL, false FROM clips c WHERE NOT EXISTS (SELECT 1 FROM speaker_names n WHERE n.name = c.name AND n.session_id = c.session_id))
    SELECT k.name, (SELECT count(DISTINCT session_id) FROM speaker_names s WHERE s.name = k.name) AS meetings, language, department, count(p.name) AS n_samples, count(*) FILTER (WHERE p.live) AS n_live
    FROM k LEFT JOIN p USING (name) GROUP BY ALL""")(join21)


def _ask(spark, sf_dir):
    """Lines on a topic, of the meetings that speak of it most, with speakers by name and all translations."""
    from ..operators import filters, tops

    lines, sessions = view(spark, sf_dir, "lines"), view(spark, sf_dir, "sessions")
    hits = filters.search_lines(lines, sessions, ["tion"])
    picked = tops.pick_sessions(tops.hits_per_session(hits), sessions.orderBy(F.desc("started")).limit(60), 8)
    chosen = O.lines_with_translations(lines, view(spark, sf_dir, "translations")).join(picked.select("session_id"), "session_id", "left_semi")
    return O.resolve_names(chosen, view(spark, sf_dir, "speaker_names")).select("session_id", "line_id", "start", "who", "source", F.size("translations").alias("n_translations")).orderBy("session_id", "start")


QUERIES["ask_pipeline"] = _ask
ORACLE_SQL["ask_pipeline"] = with_views("""
    WITH h AS (SELECT session_id, count(*) AS hits FROM (SELECT session_id FROM lines JOIN sessions USING (session_id)
        WHERE contains(translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tion') ORDER BY session_id DESC, start, line_id LIMIT 400) x GROUP BY 1),
    i AS (SELECT session_id, row_number() OVER (ORDER BY started DESC, session_id DESC) AS place FROM sessions QUALIFY row_number() OVER (ORDER BY started DESC, session_id DESC) <= 60),
    p AS (SELECT session_id FROM (SELECT h.session_id, hits, place FROM h LEFT JOIN i USING (session_id) UNION ALL SELECT session_id, 0, place FROM i WHERE session_id NOT IN (SELECT session_id FROM h)) y ORDER BY hits DESC, place NULLS LAST, session_id DESC LIMIT 8)
    SELECT l.session_id, l.line_id, l.start, coalesce(n.name, l.speaker) AS who, l.source, CAST((SELECT count(*) FROM translations t WHERE t.line_id = l.line_id) AS INT) AS n_translations
    FROM lines l JOIN p USING (session_id) LEFT JOIN speaker_names n ON n.session_id = l.session_id AND n.code = l.speaker""", "lines", "sessions", "translations", "speaker_names")
