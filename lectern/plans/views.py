"""The driver's tables seen as meetings: each view once in Spark and once in SQL, from the same formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (views it reads, SQL that Spark and DuckDB both take)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), """
        SELECT conv_id * 1000 + turn AS line_id, conv_id AS session_id, CAST(turn * 4 AS DOUBLE) AS start,
               CAST(turn * 4 + 3 AS DOUBLE) + CAST((conv_id + turn) % 4 AS DOUBLE) / 2 AS end_time,
               CASE role WHEN 'user' THEN 'S1' WHEN 'assistant' THEN 'S2' ELSE 'S3' END AS speaker,
               CASE conv_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'vi' ELSE 'en' END AS lang, text AS source,
               CASE WHEN (conv_id + turn) % 17 = 0 THEN 'asr_failed' ELSE 'ok' END AS status, turn % 11 = 5 AS refined
        FROM conversations"""),
    "translations": (("lines",), """
        SELECT line_id, 'fr' AS lang, substr(source, 1, 12) AS text FROM lines WHERE line_id % 2 = 0
        UNION ALL SELECT line_id, 'de' AS lang, substr(source, 5, 9) AS text FROM lines WHERE line_id % 3 = 0"""),
    "runs": (("lines",), """
        SELECT line_id, session_id, start, end_time, CASE WHEN CAST(floor((line_id % 1000) / 3) AS BIGINT) % 2 = 0 THEN 'S1' ELSE 'S2' END AS speaker,
               lang, concat(regexp_replace(replace(source, chr(10), ' '), '[. ]+$', ''), CASE WHEN line_id % 1000 % 3 = 2 THEN '.' ELSE '' END) AS source,
               status, refined
        FROM lines"""),
    "sessions": (("lines",), """
        SELECT session_id, TIMESTAMP '2024-01-01 00:00:00' + session_id * INTERVAL '1' DAY AS started, CAST(session_id % 3 AS INT) AS lines_rev
        FROM (SELECT DISTINCT session_id FROM lines) x"""),
    "speaker_names": (("lines",), """
        SELECT session_id, code, concat('N', CAST((session_id + n) % 12 AS STRING)) AS name
        FROM (SELECT DISTINCT session_id, speaker AS code, CAST(substr(speaker, 2) AS BIGINT) AS n FROM lines) x
        WHERE (session_id + n) % 5 <> 0"""),
    "known_prints": ((), "SELECT vec_id, concat('N', CAST(label AS STRING)) AS name, embedding AS centroid FROM embeddings WHERE vec_id % 10 = 0"),
    "voiceprints": ((), "SELECT vec_id, vec_id % 40 AS session_id, concat('S', CAST(vec_id AS STRING)) AS code, embedding AS centroid FROM embeddings WHERE vec_id % 10 <> 0"),
    "votes": ((), """
        SELECT event_id, user_id % 10 AS session_id, CAST(user_id AS STRING) AS speaker, event_type AS lang, 'x' AS text, CAST(floor(event_id / 64) AS BIGINT) AS decode, value
        FROM events"""),
    "turns": ((), """
        SELECT event_id AS turn_id, session_id, start, start + value AS end_time, CAST(event_id % 4 AS INT) AS speaker
        FROM (SELECT event_id, value, user_id % 10 AS session_id,
                     CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - min(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id % 10)) / 1000000) AS DOUBLE) / 64 AS start
              FROM events) x"""),
    "media": (("sessions",), """
        SELECT session_id AS media_id, CAST(session_id % 97 AS DOUBLE) * 10 + 0.5 AS seconds FROM sessions
        UNION ALL SELECT session_id + 1000000 AS media_id, CAST(session_id % 97 AS DOUBLE) * 10 + 1.5 AS seconds FROM sessions WHERE session_id % 5 = 0"""),
    "terms": ((), """
        SELECT item_id AS id, regexp_extract(text, '[A-Za-z]{5,}', 0) AS source, 'en' AS lang,
               CASE item_id % 4 WHEN 0 THEN 'translate' WHEN 1 THEN 'keep' WHEN 2 THEN 'hint' ELSE 'protect' END AS mode
        FROM benchmark WHERE regexp_extract(text, '[A-Za-z]{5,}', 0) <> ''"""),
    "scored": ((), """
        SELECT d.doc_id, d.text, d.lang, d.source, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS no_speech, l.quality = 0 AS junk
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "edits": (("lines",), """
        SELECT line_id, session_id, n, CASE n WHEN 0 THEN 'hand' WHEN 1 THEN 'rerun' ELSE 'model' END AS kind,
               CASE WHEN n = 1 AND line_id % 20 = 0 THEN source ELSE concat(source, ' e', CAST(n AS STRING)) END AS text
        FROM lines, (SELECT 0 AS n UNION ALL SELECT 1 AS n UNION ALL SELECT 2 AS n) k WHERE speaker = 'S1'"""),
    "segments": (("lines",), "SELECT line_id AS segment_id, session_id, start + 0.25 AS start, end_time + 0.25 AS end_time, source AS text FROM lines"),
}

TABLES = ("conversations", "documents", "embeddings", "events", "benchmark", "labels", "pages")


def needed(names: tuple[str, ...] | list[str]) -> list[str]:
    """The views and what they read, those read first."""
    out: list[str] = []
    for n in names:
        for x in (*needed(VIEWS[n][0]), n):
            if x not in out:
                out.append(x)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver's."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, body = VIEWS[name]
    sources = {r: view(spark, sf_dir, r) for r in reads}
    sources |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in body}
    for key, df in sources.items():
        df.createOrReplaceTempView(f"_v_{key}")
        body = _replace_table(body, key, f"_v_{key}")
    return spark.sql(body)


def _replace_table(body: str, name: str, by: str) -> str:
    import re

    return re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {by}", body)


def with_views(body: str, *names: str) -> str:
    """SQL for DuckDB: the views as common tables, then the body (which may start with further ones)."""
    parts = [f"{n} AS ({_duck(VIEWS[n][1])})" for n in needed(names)]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*parts, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def _duck(body: str) -> str:
    return body.replace("unix_micros(", "epoch_us(")
