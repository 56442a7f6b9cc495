"""Queries of windows, folds, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, tops
from ..operators import windows as O
from .registry import query

_W = "(PARTITION BY session_id ORDER BY start, line_id)"
_NAMED = f"lag(speaker) OVER {_W}"


@query("win1_turns", f"""
    WITH m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND lag(lang) OVER w = lang AND start - lag(start) OVER w <= 20 THEN 0 ELSE 1 END AS brk FROM runs WINDOW w AS {_W}),
    t AS (SELECT *, sum(brk) OVER {_W} AS turn FROM m)
    SELECT session_id, CAST(turn AS BIGINT) AS turn, min(speaker) AS speaker, min(lang) AS lang, min(start) AS start, string_agg(CASE WHEN brk = 0 AND regexp_matches(source, '^[，。、,.]') THEN source WHEN brk = 0 THEN concat(' ', source) ELSE source END, '' ORDER BY start, line_id) AS text, count(*) AS n_lines
    FROM t GROUP BY 1, 2""")
def win1(runs):
    return O.turns(runs)


@query("win2_heal_turns", """
    WITH b AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS c FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY start, turn_id)),
    k AS (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY start, turn_id) AS g FROM b),
    m AS (SELECT *, max(end_time) OVER (PARTITION BY session_id, g ORDER BY start, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM k),
    i AS (SELECT *, sum(CASE WHEN e IS NULL OR start - e >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, g ORDER BY start, turn_id) AS h FROM m)
    SELECT session_id, min(speaker) AS speaker, min(start) AS start, max(end_time) AS end_time FROM i GROUP BY session_id, g, h""")
def win2(turns):
    return O.heal_turns(turns)


@query("win3_merge_runs", f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER {_W} AS n FROM runs),
    f AS (SELECT session_id, n, line_id, speaker, end_time, start AS began, CAST(1 AS BIGINT) AS run FROM o WHERE n = 1
      UNION ALL SELECT o.session_id, o.n, o.line_id, o.speaker, o.end_time,
        CASE WHEN o.speaker = f.speaker AND o.start - f.end_time BETWEEN 0 AND 2 AND o.end_time - f.began <= 20 THEN f.began ELSE o.start END,
        f.run + CASE WHEN o.speaker = f.speaker AND o.start - f.end_time BETWEEN 0 AND 2 AND o.end_time - f.began <= 20 THEN 0 ELSE 1 END
        FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
    SELECT line_id, CAST(run AS INT) AS run FROM f""")
def win3(runs):
    return O.merge_runs(runs).select("line_id", "run")


def _fragments(seconds: int, chars: int, terminal: bool) -> str:
    ok = f"""o.speaker = f.speaker AND o.lang = f.lang AND o.status = 'ok' AND f.status = 'ok' AND NOT o.refined AND NOT f.refined AND o.start - f.end_time <= 1
        AND o.end_time - f.began <= {seconds} AND f.chars + len(o.source) <= {chars}""" + (" AND rtrim(f.source) <> '' AND NOT contains('。．.！!？?…', right(rtrim(f.source), 1))" if terminal else "")
    return f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER {_W} AS n FROM runs),
    f AS (SELECT session_id, n, line_id, speaker, lang, status, refined, source, end_time, start AS began, len(source) AS chars, CAST(1 AS BIGINT) AS run FROM o WHERE n = 1
      UNION ALL SELECT o.session_id, o.n, o.line_id, o.speaker, o.lang, o.status, o.refined, o.source, o.end_time, CASE WHEN {ok} THEN f.began ELSE o.start END,
        CASE WHEN {ok} THEN f.chars + len(o.source) ELSE len(o.source) END, f.run + CASE WHEN {ok} THEN 0 ELSE 1 END FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
    SELECT line_id, CAST(run AS INT) AS run FROM f QUALIFY count(*) OVER (PARTITION BY session_id, run) > 1"""


@query("win4_merge_fragments", _fragments(30, 1200, True))
def win4(runs):
    return O.merge_fragments(runs, chars=1200).select("line_id", "run")


@query("win5_candidate_runs", _fragments(60, 2400, False))
def win5(runs):
    return O.candidate_runs(runs, chars=2400).select("line_id", "run")


@query("win6_join_lines", """
    WITH r AS (SELECT *, CAST(floor((line_id % 1000) / 2) AS BIGINT) AS run FROM runs)
    SELECT session_id, run, min(line_id) AS line_id, min(start) AS start, max_by(end_time, line_id) AS end_time,
           CASE WHEN lang = 'zh' THEN coalesce(string_agg(CASE WHEN trim(source) <> '' THEN trim(source) END, '' ORDER BY line_id), '') ELSE coalesce(string_agg(CASE WHEN trim(source) <> '' THEN trim(source) END, ' ' ORDER BY line_id), '') END AS source
    FROM r GROUP BY session_id, run, lang""")
def win6(runs):
    r = runs.withColumn("run", F.floor(F.col("line_id") % 1000 / 2))
    return O.join_lines(r).select("session_id", "run", "line_id", "start", "end_time", "source")


_BLANK = "SELECT line_id, session_id, start, end_time, CASE WHEN line_id % 3 = 1 THEN speaker END AS v, speaker FROM runs"


@query("win7_inherit_speaker", f"SELECT line_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start, line_id), first_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start, line_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') AS speaker FROM ({_BLANK}) x")
def win7(runs):
    blank = runs.withColumn("speaker", F.when(F.col("line_id") % 3 == 1, F.col("speaker")).otherwise(""))
    return O.inherit_speaker(blank).select("line_id", "speaker")


@query("win8_absorb_strays", """
    WITH t AS (SELECT *, sum(end_time - start) OVER (PARTITION BY session_id, s) AS total FROM (SELECT *, CASE WHEN turn_id % 41 = 0 THEN 100 + CAST(turn_id % 7 AS INT) ELSE speaker END AS s FROM turns) y),
    k AS (SELECT *, CASE WHEN total >= 300 THEN s END AS v FROM t)
    SELECT turn_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start, turn_id), first_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start, turn_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), s) AS speaker FROM k""")
def win8(turns):
    marked = turns.withColumn("speaker", F.when(F.col("turn_id") % 41 == 0, (100 + F.col("turn_id") % 7).cast("int")).otherwise(F.col("speaker")))
    return O.absorb_strays(marked, 300.0).select("turn_id", "speaker")


@query("win9_speaker_samples", f"""
    WITH m AS (SELECT *, end_time - start AS span, coalesce(lag(speaker) OVER {_W} <> speaker, false) AS ob, coalesce(lead(speaker) OVER {_W} <> speaker, false) AS oa FROM runs),
    b AS (SELECT *, CASE WHEN ob THEN least(0.6, span / 4) ELSE 0 END AS head FROM m QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY (span >= 3) DESC, CAST(ob AS INT) + CAST(oa AS INT), abs(span - 8), len(source) DESC, line_id) = 1)
    SELECT session_id, speaker, line_id, round(start + head, 6) AS start, round(end_time - CASE WHEN oa THEN least(0.6, (span - head) / 4) ELSE 0 END, 6) AS end_time FROM b""")
def win9(runs):
    return O.speaker_samples(runs).select("session_id", "speaker", "line_id", F.round("start", 6).alias("start"), F.round("end_time", 6).alias("end_time"))


@query("win10_voiceprint_samples", f"""
    WITH m AS (SELECT *, end_time - start AS span, coalesce(lag(speaker) OVER {_W} <> speaker, false) OR coalesce(lead(speaker) OVER {_W} <> speaker, false) AS near FROM runs)
    SELECT session_id, speaker, line_id FROM m WHERE span >= 1 QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY near, abs(span - 8), start, line_id) <= 2""")
def win10(runs):
    return O.voiceprint_samples(runs, 2).select("session_id", "speaker", "line_id")


@query("win11_context_lines", """
    SELECT line_id, coalesce(array_to_string(list(source) OVER (PARTITION BY session_id ORDER BY start, line_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS context FROM runs""")
def win11(runs):
    return O.context_lines(runs).select("line_id", F.array_join("context", "|").alias("context"))


@query("win12_chunks", f"SELECT line_id, CAST((row_number() OVER {_W} - 1) // 3 AS BIGINT) AS chunk, (row_number() OVER {_W} - 1) % 3 + 1 AS place FROM lines")
def win12(lines):
    return O.chunks(lines, 3).select("line_id", "chunk", F.col("place").cast("long").alias("place"))


def _even(src: str, keys: str, whole: str, budget: str) -> str:
    return f"""SELECT * EXCLUDE (total, i, n, take, k) FROM (SELECT *, CAST(ceil(CAST(i AS DOUBLE) * take / n) AS BIGINT) AS k FROM (
        SELECT *, greatest(1, CAST(round_even(CAST(n AS DOUBLE) * {budget} / total, 0) AS BIGINT)) AS take FROM (
        SELECT *, sum(len(source)) OVER (PARTITION BY {whole}) AS total, row_number() OVER (PARTITION BY {keys} ORDER BY start, line_id) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}) a) b) c
        WHERE total <= {budget} OR (k < take AND CAST(floor(CAST(k AS DOUBLE) * n / take) AS BIGINT) = i)"""


@query("win13_even_sample", f"WITH p AS ({_even('lines', 'session_id, speaker', 'session_id', '700')}), q AS ({_even('p', 'session_id', 'session_id', '700')}) SELECT line_id FROM q")
def win13(lines):
    return O.even_sample(lines, F.lit(700)).select("line_id")


@query("win14_fit_sessions", f"""
    WITH s AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS had, CAST(floor(60000 / (SELECT count(DISTINCT session_id) FROM lines)) AS BIGINT) AS share FROM lines),
    p AS ({_even('s', 'session_id, speaker', 'session_id', 'share')}), q AS ({_even('p', 'session_id', 'session_id', 'share')})
    SELECT line_id, count(*) OVER (PARTITION BY session_id) < had AS cut FROM q""")
def win14(lines):
    return O.fit_sessions(lines, 60000).select("line_id", "cut")


@query("win15_inherit_short", f"""
    WITH k AS (SELECT *, CASE WHEN end_time - start >= 4 THEN speaker END AS v FROM runs)
    SELECT line_id, coalesce(last_value(v IGNORE NULLS) OVER {_W}, first_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY start, line_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'S1') AS speaker FROM k""")
def win15(runs):
    return O.inherit_short(runs, 4.0).select("line_id", "speaker")


@query("win16_boundary_flags", f"SELECT line_id, coalesce(lag(speaker) OVER {_W} <> speaker, false) AS other_before, coalesce(lead(speaker) OVER {_W} <> speaker, false) AS other_after FROM runs")
def win16(runs):
    return O.boundary_flags(runs).select("line_id", "other_before", "other_after")


@query("win17_chunk_spans", """
    WITH m AS (SELECT session_id, CAST(session_id * 7 % 900 AS DOUBLE) AS seconds FROM sessions), c AS (SELECT session_id, seconds, unnest(range(CAST(greatest(1, ceil(seconds / 180)) AS BIGINT))) AS chunk FROM m)
    SELECT session_id, chunk, CAST(chunk * 180 AS DOUBLE) AS core_start, least((chunk + 1) * 180, seconds) AS core_end, CAST(greatest(chunk * 180 - 20, 0) AS DOUBLE) AS read_start, least(least((chunk + 1) * 180, seconds) + 20, seconds) AS read_end FROM c""")
def win17(sessions):
    return O.chunk_spans(sessions.select("session_id", (F.col("session_id") * 7 % 900).cast("double").alias("seconds")))


# ---- rankings ----


@query("top1_pick_sessions", """
    WITH h AS (SELECT session_id, count(*) AS hits FROM lines WHERE contains(source, 'ing') GROUP BY 1), i AS (SELECT session_id, row_number() OVER (ORDER BY started DESC, session_id DESC) AS place FROM sessions)
    SELECT session_id, hits FROM (SELECT h.session_id, hits, place FROM h LEFT JOIN i USING (session_id) UNION ALL SELECT session_id, 0, place FROM i WHERE session_id NOT IN (SELECT session_id FROM h)) x
    ORDER BY hits DESC, place NULLS LAST, session_id DESC LIMIT 30""")
def top1(lines, sessions):
    hits = tops.hits_per_session(lines.where(F.col("source").contains("ing")))
    return tops.pick_sessions(hits, sessions, 30)


@query("top2_summary_index", """
    SELECT session_id, CASE WHEN session_id % 4 <> 1 AND session_id % 5 <> 2 THEN concat('T', session_id) ELSE '' END AS title, '' AS decisions FROM sessions ORDER BY started DESC, session_id DESC LIMIT 60""")
def top2(sessions):
    n = F.col("session_id")
    body = F.when(n % 5 == 2, F.lit("{broken")).otherwise(F.concat(F.lit('{"en": {"title": "T'), n.cast("string"), F.lit('"}}')))
    summaries = sessions.select("session_id", body.alias("json"), F.when(n % 4 == 1, "failed").otherwise("ok").alias("status"))
    return tops.summary_index(sessions, summaries).select("session_id", "title", "decisions")


@query("top3_top_changes", """
    SELECT class, was, now, n FROM (SELECT class, substr(source, i, 3) AS was, substr(source, i + 3, 1) AS now, count(*) AS n FROM (SELECT lang AS class, source, unnest(range(1, greatest(len(source), 1) + 1)) AS i FROM runs) y GROUP BY ALL) x QUALIFY row_number() OVER (PARTITION BY class ORDER BY n DESC, was, now) <= 10""")
def top3(runs):
    chars = runs.select(F.col("lang").alias("class"), F.split("source", "").alias("chars"))
    return tops.top_changes(chars.select("class", F.inline(T.places(F.col("chars"), 3))))


@query("top4_order_corrections", "SELECT source AS wrong, row_number() OVER (ORDER BY len(source) DESC, source, id) AS place FROM terms")
def top4(terms):
    from pyspark.sql import Window

    ordered = tops.order_corrections(terms.select("id", F.col("source").alias("wrong")))
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.length("wrong")), "wrong", "id")).cast("long")).select("wrong", "place")


@query("top5_speaker_code_order", "SELECT speaker FROM (SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN 'room' ELSE concat('S', event_id % 23) END AS speaker FROM events) x ORDER BY 1")
def top5(events):
    codes = events.select(F.when(F.col("event_id") % 7 == 0, F.lit("room")).otherwise(F.concat(F.lit("S"), (F.col("event_id") % 23).cast("string"))).alias("speaker")).distinct()
    return tops.speaker_code_order(codes)


@query("top6_screen_lines", "SELECT line_id FROM lines QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY start DESC, line_id DESC) <= 3")
def top6(lines):
    return tops.screen_lines(lines, 3).select("line_id")


@query("set1_union_distinct", "SELECT speaker AS name FROM lines UNION SELECT name FROM speaker_names")
def set1(lines, speaker_names):
    return lines.select(F.col("speaker").alias("name")).union(speaker_names.select("name")).distinct()


@query("set2_except", "SELECT t.source AS term FROM (SELECT DISTINCT source FROM terms) t WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE contains(lower(l.source), lower(t.source)))")
def set2(lines, terms):
    hits = filters.relevant_terms(lines, terms).select("term").distinct()
    return terms.select(F.col("source").alias("term")).distinct().join(hits, "term", "left_anti")


@query("set3_with_index_picks", """
    WITH h AS (SELECT session_id, count(*) AS hits FROM lines WHERE speaker = 'S3' GROUP BY 1) SELECT session_id, hits FROM h UNION ALL
    SELECT session_id, 0 FROM (SELECT DISTINCT session_id FROM sessions WHERE lines_rev = 1) p WHERE session_id NOT IN (SELECT session_id FROM h) AND (SELECT count(*) FROM h) < 2""")
def set3(lines, sessions):
    return tops.with_index_picks(tops.hits_per_session(lines.where("speaker = 'S3'")), sessions.where("lines_rev = 1"))


