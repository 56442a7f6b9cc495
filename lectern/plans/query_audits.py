"""Queries of prompts and reply audits. Replies are made from the lines themselves, so that what should pass is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as O
from ..operators import windows
from .query_correct import key_of, proposals
from .registry import query


@query("aud1_accept")
def aud1(edits, terms):
    return O.accept(proposals(edits), terms, key_of).select("line_id", "accepted")


@query("aud1_accept_by_size", """
    WITH p AS (SELECT line_id, regexp_replace(source, '[^ -~]', '', 'g') AS o FROM lines), c AS (SELECT line_id, o, replace(o, 'th', 'dh') AS c FROM p)
    SELECT line_id, c <> '' AND trim(c) <> o AND regexp_replace(trim(c), '\\s+', '', 'g') <> regexp_replace(o, '\\s+', '', 'g') AND levenshtein(o, trim(c)) <= greatest(2, CAST(floor(len(o) * 0.3) AS INT)) AND levenshtein(o, trim(c)) <= least(len(o) * 0.2, 3) AS accepted FROM c""".replace("\\\\", "\\"))
def aud1b(lines):
    p = lines.select("line_id", F.regexp_replace("source", "[^ -~]", "").alias("original"))
    return O.accept(p.withColumn("candidate", F.regexp_replace("original", "th", "dh"))).select("line_id", "accepted")


def _chunked(runs):
    return windows.chunks(runs, 4)


def _replies(parts, text):
    row = F.concat(F.col("place").cast("string"), F.lit(": "), text)
    return parts.groupBy("session_id", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", row.alias("r")))), lambda x: x["r"]), "\n").alias("reply"))


@query("aud2_audit_refine")
def aud2(runs):
    parts = _chunked(runs)
    some = parts.where("place = 2 OR speaker = 'S1'")
    return O.audit_refine(_replies(some, F.regexp_replace("source", "th", "dh")), parts).select("line_id", "refined_text", "refused", "skipped")


@query("aud3_audit_groups", """
    WITH p AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY start, line_id) - 1) // 4 AS run, (row_number() OVER (PARTITION BY session_id ORDER BY start, line_id) - 1) % 4 + 1 AS place, source FROM runs), n AS (SELECT *, count(*) OVER (PARTITION BY session_id, run) AS n FROM p)
    SELECT session_id, run, CAST(min(place) AS INT) AS first, CAST(max(place) AS INT) AS last, trim(concat(string_agg(source, ' ' ORDER BY place), '.')) AS text FROM n WHERE n >= 2 AND session_id % 3 <> 0
    GROUP BY session_id, run, CASE WHEN place <= 2 THEN 0 ELSE place END""")
def aud3(runs):
    parts = _chunked(runs).select("session_id", F.col("chunk").alias("run"), "place", "source")
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("session_id", "run"))
    parts = parts.withColumn("n", n).where("n >= 2")
    group = F.when(F.col("place") <= 2, 0).otherwise(F.col("place"))
    one = parts.groupBy("session_id", "run", group.alias("g")).agg(F.min("place").alias("a"), F.max("place").alias("b"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]), " ").alias("t"))
    text = F.when(F.col("session_id") % 3 == 0, F.concat(F.col("t"), F.lit(" more"))).otherwise(F.concat(F.col("t"), F.lit(".")))
    row = F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit(": "), text)
    replies = one.groupBy("session_id", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", row.alias("r")))), lambda x: x["r"]), "\n").alias("reply"))
    return O.audit_groups(replies, parts)


@query("aud4_audit_punctuation", """
    SELECT line_id, CASE WHEN NOT refined AND line_id % 3 <> 0 AND regexp_matches(source, '[\\p{L}]') THEN trim(concat(source, '!')) ELSE source END AS punctuated FROM runs""".replace("\\\\", "\\"))
def aud4(runs):
    parts = _chunked(runs)
    text = F.when(F.col("line_id") % 3 == 0, F.concat(F.lit("x "), "source")).otherwise(F.concat("source", F.lit("!")))
    out = O.audit_punctuation(_replies(parts, text), parts)
    return out.select("line_id", F.when(F.col("source").rlike(r"\p{L}"), F.col("punctuated")).otherwise(F.col("source")).alias("punctuated"))


@query("aud5_audit_summary", """
    SELECT session_id, 'DECISIONS' AS section, 'agreed' AS text, NULL AS speaker, min(line_id) AS line_id FROM lines GROUP BY 1
    UNION ALL SELECT session_id, 'DECISIONS', 'unfounded', NULL, NULL FROM sessions UNION ALL SELECT session_id, 'ACTIONS', 'do it', CASE WHEN bool_or(speaker = 'S2') THEN 'S2' ELSE '' END, min(line_id) FROM lines GROUP BY 1""")
def aud5(lines, sessions):
    first = lines.groupBy("session_id").agg(F.min("line_id").cast("string").alias("n"))
    reply = F.concat(F.lit("TITLE: t\nSUMMARY: s\nmore\nDECISIONS:\n- agreed || "), "n", F.lit("\n- unfounded || 99999999\nACTIONS:\n* do it || S2 ["), "n", F.lit("]\nRISKS:"))
    items, _ = O.audit_summary(first.select("session_id", reply.alias("reply")), lines)
    return items.select("session_id", "section", "text", "speaker", "line_id")


@query("aud6_audit_translation", "SELECT event_id, event_id % 4 <> 0 AS accepted, CASE WHEN event_id % 4 <> 0 THEN event_type END AS fr, CASE WHEN event_id % 4 = 1 THEN 'old' END AS previous FROM events")
def aud6(events):
    n = F.col("event_id") % 4
    body = F.concat(F.lit('```{"translations": {"fr": "'), "event_type", F.lit('", "xx": "no"}, "previous": '), F.when(n == 1, '{"source": "old"}').otherwise("{}"), F.lit("}```"))
    replies = events.select("event_id", F.when(n == 0, "none").otherwise(body).alias("reply"), F.array(F.lit("fr"), F.lit("de")).alias("targets"))
    return O.audit_translation(replies).select("event_id", "accepted", F.try_element_at("translations", F.lit("fr")).alias("fr"), F.col("previous_source").alias("previous"))


@query("aud7_audit_keywords", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(event_type, ',ok') END AS keywords, CASE WHEN event_id % 3 = 1 THEN '2024-02-29' END AS since FROM events")
def aud7(events):
    n = F.col("event_id") % 3
    body = F.concat(F.lit('{"keywords": [" '), "event_type", F.lit(' ", "x", 5, "ok", "ok"], "since": "'), F.when(n == 1, "2024-02-29").otherwise("2024-02-30"), F.lit('"}'))
    replies = events.select("event_id", F.when(n == 0, "sorry").otherwise(body).alias("reply"))
    return O.audit_keywords(replies).select("event_id", F.array_join("keywords", ",").alias("keywords"), "since")


@query("aud7_audit_sessions", "SELECT e.event_id AS reply_id, s.session_id FROM events e JOIN sessions s ON s.session_id IN (e.event_id % 50, 3)")
def aud7b(events, sessions):
    body = F.concat(F.lit('{"sessions": ['), (F.col("event_id") % 50).cast("string"), F.lit(', "3", 99999, "x", 3]}'))
    return O.audit_sessions(events.select(F.col("event_id").alias("reply_id"), body.alias("reply")), sessions).select("reply_id", "session_id")


@query("aud8_prompt_rows")
def aud8(runs, terms):
    return O.prompt_rows(runs, terms, "Terms: {terms}\nBefore:\n{context}\nLines:\n{lines}\n{note}", 4)


@query("aud9_summary_status", """
    SELECT session_id, CASE session_id % 4 WHEN 0 THEN 'no_llm' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' ELSE 'ok' END AS status FROM sessions""")
def aud9(sessions):
    wanted = sessions.select("session_id", F.explode(F.array(F.lit("en"), F.lit("zh"))).alias("lang"))
    n = F.col("session_id") % 4
    results = wanted.where("session_id % 4 <> 0").withColumn("parsed", (n == 3) | ((n == 2) & (F.col("lang") == "en")))
    return O.summary_status(wanted, results)
