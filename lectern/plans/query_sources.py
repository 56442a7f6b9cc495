"""Queries of sources, sinks, evaluation and streaming twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import correction as C
from ..operators import evaluate as E
from ..operators import joins
from ..sources import transcripts as O
from ..streaming import live as S
from .registry import query


def _folder(df, name: str) -> str:
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lectern-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src1_snk4_transcripts", """
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY start, line_id) - 1 AS place, start, speaker, lang, regexp_replace(source, '[\\r\\n]+', ' ', 'g') AS text FROM lines""".replace("\\\\", "\\"))
def src1(lines):
    path = _folder(lines, "transcripts")
    O.write_transcripts(lines, path)
    back = O.read_transcripts(lines.sparkSession, path)
    return back.select(F.regexp_extract("file", r"session_id=([0-9]+)", 1).cast("long").alias("session_id"), F.col("place").cast("long").alias("place"), "start", "speaker", "lang", "text")


@query("src2_read_proposals", "SELECT trim(source) AS before, trim(replace(source, 'th', 'dh')) AS after FROM runs WHERE trim(source) <> ''")
def src2(runs):
    path = _folder(runs, "proposals")
    a, b = F.trim("source"), F.trim(F.replace("source", F.lit("th"), F.lit("dh")))
    good = runs.where(a != "")
    good.select(F.concat(F.lit("noise\n  [1:02] "), a, F.lit("\n      -> "), b).alias("value")).write.text(path)
    return O.read_proposals(runs.sparkSession, path).select("before", "after")


@query("src3_snk1_vtt", """
    WITH n AS (SELECT l.*, coalesce(n.name, speaker) AS who, lead(start) OVER (PARTITION BY l.session_id ORDER BY start, line_id) AS nxt FROM lines l LEFT JOIN speaker_names n ON n.session_id = l.session_id AND n.code = l.speaker)
    SELECT session_id, start, greatest(least(end_time, coalesce(nxt, end_time)), start + 0.1) AS end_time, trim(regexp_replace(concat(who, ': ', trim(source)), '\\s+', ' ', 'g')) AS text FROM n WHERE NOT contains(source, '&') AND NOT contains(source, '<') AND NOT contains(source, '>')""".replace("\\\\", "\\"))
def src3(lines, speaker_names):
    path = _folder(lines, "vtt")
    O.write_documents(O.to_vtt(lines, speaker_names), path)
    back = O.read_vtt(lines.sparkSession, path)
    return back.where("NOT contains(text, '&')").select(F.regexp_extract("file", r"session_id=([0-9]+)", 1).cast("long").alias("session_id"), "start", "end_time", "text")


@query("src4_pick_subtitle_track", """
    WITH t AS (SELECT doc_id % 50 AS media_id, concat('t', doc_id) AS track, concat(upper(lang), '-X') AS lang FROM documents)
    SELECT media_id, track FROM t QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY CASE lower(string_split(lang, '-')[1]) WHEN 'es' THEN 1 WHEN 'de' THEN 2 ELSE 99 END, track) = 1""")
def src4(documents):
    return O.pick_subtitle_track(documents.select((F.col("doc_id") % 50).alias("media_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("track"), F.concat(F.upper("lang"), F.lit("-X")).alias("lang")), ["es-MX", "de"])


@query("src5_meeting_time", """
    SELECT event_id, CASE WHEN event_id % 13 BETWEEN 1 AND 12 THEN make_timestamp(2024, event_id % 13, event_id % 28 + 1, 10, event_id % 60, 5) ELSE TIMESTAMP '2020-01-01 00:00:00' END AS at FROM events""")
def src5(events):
    n = F.col("event_id")
    name = F.concat(F.lit("rec_2024-"), F.lpad((n % 13).cast("string"), 2, "0"), F.lit("-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("_10"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit("05.wav"))
    return events.select("event_id", O.meeting_time(name, F.lit("2020-01-01 00:00:00").cast("timestamp")).alias("at"))


@query("src6_subtitle_lines", "SELECT session_id, line_id, 'S1' AS speaker, lower(source) AS source FROM lines")
def src6(lines):
    cues = lines.select("session_id", F.col("line_id").alias("block"), "start", "end_time", F.col("source").alias("text"))
    return O.subtitle_lines(cues, "en", F.lower).select("session_id", "line_id", "speaker", "source")


@query("src7_store", "SELECT line_id, speaker, false AS refined, 'ok' AS status FROM lines")
def src7(lines):
    path = _folder(lines, "store")
    O.write_store({"lines": lines.select("line_id", "speaker")}, path)
    return O.read_store(lines.sparkSession, path, {"lines": "line_id long, speaker string, refined boolean, status string"})["lines"]


@query("src8_portable_path", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('a/', event_id, '.wav') WHEN 1 THEN concat('recordings/', event_id, '.wav') ELSE concat('x/', event_id) END AS path FROM events""")
def src8(events):
    n, k = F.col("event_id") % 3, F.col("event_id").cast("string")
    path = F.when(n == 0, F.concat(F.lit("/srv/data/a/"), k, F.lit(".wav"))).when(n == 1, F.concat(F.lit("/old/place/recordings/"), k, F.lit(".wav"))).otherwise(F.concat(F.lit("x/"), k))
    return events.select("event_id", O.portable_path(path, "/srv/data").alias("path"))


@query("src9_recent_corpus", "SELECT line_id, source FROM lines ORDER BY line_id DESC LIMIT 200")
def src9(lines):
    return O.recent_corpus(lines, 200)


@query("snk2_markdown")
def snk2(lines, translations, speaker_names):
    full = joins.lines_with_translations(lines, translations)
    summaries = lines.groupBy("session_id").agg(F.concat(F.lit("About "), F.first("lang")).alias("summary"), F.lit("ok").alias("status"), (F.count("*") % 2 == 0).alias("stale"))
    return O.to_markdown(full, speaker_names, summaries).select("session_id", F.length("value").alias("chars"), (F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).alias("rows"))


@query("snk3_turn_document")
def snk3(runs):
    return O.turn_document(runs).select("session_id", F.md5("value").alias("digest"))


@query("sca13_char_diff")
def sca13(edits):
    @F.pandas_udf("string")
    def diff(a, b):
        import pandas as pd

        return pd.Series([" ".join(f"{k}:{t}" for k, t in C.char_diff(x, y)) for x, y in zip(a, b, strict=True)])

    one = edits.where("n = 0").select("line_id", F.col("text").alias("a"))
    return one.select("line_id", diff("a", F.regexp_replace("a", "th", "dh")).alias("diff"))


def _hyp(runs):
    return runs.withColumn("source", F.regexp_replace("source", " th", " dh")).withColumn("speaker", F.when(F.col("line_id") % 9 == 0, "S2").otherwise(F.col("speaker")))


@query("agg3_error_rate")
def agg3(runs):
    return E.error_rate(runs, _hyp(runs))


@query("agg4_speaker_error", """
    WITH w AS (SELECT session_id, speaker AS r, CASE WHEN line_id % 9 = 0 THEN 'S2' ELSE speaker END AS h, greatest(1, len(regexp_replace(source, '[\\s，。、！？：；「」『』（）,.!?:;"''()\\-—…]+', '', 'g'))) AS w FROM runs),
    m AS (SELECT session_id, r, h, sum(w) AS w FROM w GROUP BY ALL), t AS (SELECT session_id, sum(w) AS t, count(DISTINCT r) AS nr, count(DISTINCT h) AS nh FROM w GROUP BY 1),
    s AS (SELECT session_id, coalesce(sum(w) FILTER (WHERE r = h), 0) AS a, coalesce(sum(w) FILTER (WHERE r <> h), 0) AS b, coalesce(max(w), 0) AS one FROM m GROUP BY 1)
    SELECT session_id, CASE WHEN nr = 1 OR nh = 1 THEN round(1 - one / t, 4) ELSE round(1 - greatest(a, b) / t, 4) END AS error, nr AS ref_speakers, nh AS hyp_speakers FROM s JOIN t USING (session_id)""".replace("\\\\", "\\"))
def agg4(runs):
    return E.speaker_error(runs, _hyp(runs)).select("session_id", "error", "ref_speakers", "hyp_speakers")


@query("join14_split_on_turns")
def join14(lines, turns):
    at = F.col("session_id").cast("double") * 8
    utts = lines.select((F.col("session_id") % 10).alias("session_id"), "line_id", (at + F.col("start")).alias("start"), (at + F.col("end_time")).alias("end_time"))
    return E.split_on_turns(utts, turns)


# ---- streaming: the batch twins ----


@query("str1_assign_online")
def str1(embeddings):
    v = embeddings.select((F.col("vec_id") % 20).alias("session_id"), F.col("vec_id").alias("seq"), F.concat(F.lit("c"), (F.col("vec_id") % 2).cast("string")).alias("channel"), ((F.col("vec_id") % 7).cast("double") / 2).alias("seconds"), "embedding")
    return S.assign_online(v, threshold=0.1)


@query("str2_track_language")
def str2(votes):
    return S.track_language(votes.select("session_id", "speaker", F.col("event_id").alias("seq"), "lang"))


@query("str3_retry_buffer")
def str3(votes):
    n = F.col("event_id")
    kind = F.when(n % 10 < 4, "fail").when(n % 500 == 499, "end").otherwise("language")
    return S.retry_buffer(votes.select("session_id", n.alias("seq"), kind.alias("kind"), "speaker", n.alias("item"), "lang"), 24)


@query("str4_remember_online")
def str4(known_prints):
    return S.remember_online(known_prints.select("name", F.col("vec_id").alias("seq"), "centroid"), 0.3, 4)


@query("str5_merge_lines", """
    WITH e AS (SELECT session_id, line_id AS id, line_id * 10 + n AS seq, CASE WHEN n = 0 THEN -CAST(line_id % 7 AS DOUBLE) ELSE 0 END AS start, text AS source FROM edits),
    f AS (SELECT session_id, id, max_by(source, seq) AS source, max_by(start, seq) AS start, min_by(start, seq) AS order_key, min(seq) AS first_seq FROM e GROUP BY ALL)
    SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY order_key DESC, first_seq DESC) <= 2""")
def str5(edits):
    e = edits.select("session_id", F.col("line_id").alias("id"), (F.col("line_id") * 10 + F.col("n")).alias("seq"), F.when(F.col("n") == 0, -(F.col("line_id") % 7).cast("double")).otherwise(0.0).alias("start"), F.col("text").alias("source"))
    return S.merge_lines(e, 2)


@query("str6_refine_previous", "SELECT line_id, CASE WHEN speaker = 'S1' THEN concat(source, ' e0') ELSE source END AS source, refined OR speaker = 'S1' AS refined FROM lines")
def str6(lines, edits, translations):
    revisions = edits.select("line_id", F.col("n").alias("seq"), F.col("text").alias("source"), F.create_map(F.lit("fr"), "text").alias("translations"))
    return S.refine_previous(joins.lines_with_translations(lines, translations), revisions).select("line_id", "source", "refined")


@query("str7_live_lines")
def str7(lines, embeddings):
    u = lines.withColumn("vec_id", F.col("line_id") % 500).join(embeddings.select("vec_id", "embedding"), "vec_id")
    u = u.select("session_id", F.col("line_id").alias("seq"), F.lit("mic").alias("channel"), (F.col("end_time") - F.col("start")).alias("seconds"), "embedding", "lang", F.when(F.col("line_id") % 5 == 0, "").otherwise(F.col("source")).alias("text"))
    return S.live_lines(u, F.upper, threshold=0.1)[0]


@query("str8_channel_end", """
    WITH f AS (SELECT session_id, CAST(event_id % 3 AS VARCHAR) AS channel, min(event_id) AS seq FROM votes WHERE value > 90 GROUP BY ALL) SELECT session_id, max(seq) AS seq FROM f GROUP BY 1 HAVING count(*) = 3""")
def str8(votes):
    return S.channel_end(votes.where("value > 90").select("session_id", F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("string").alias("channel")), 3)
