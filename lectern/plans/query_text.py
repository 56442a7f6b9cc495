"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query


@query("sca1_edit_distance", "SELECT line_id, levenshtein(p, replace(replace(p, 'th', 'd'), 'e', '')) AS distance FROM (SELECT line_id, regexp_replace(source, '[^ -~]', '', 'g') AS p FROM lines) x")
def sca1(lines):
    plain = F.regexp_replace("source", "[^ -~]", "")
    heard = F.replace(F.replace(plain, F.lit("th"), F.lit("d")), F.lit("e"))
    return lines.select("line_id", T.edit_distance(plain, heard).cast("long").alias("distance"))


@query("sca2_sound_key", "SELECT line_id, replace(replace(lower(source), 'c', 'k'), 'z', 's') AS key FROM lines")
def sca2(lines):
    readings = F.create_map(*(F.lit(x) for x in ("c", "k", "z", "s")))
    return lines.select("line_id", T.sound_key(F.lower("source"), readings).alias("key"))


@query("sca3_normalize", "SELECT line_id, regexp_replace(source, '[\\s，。、！？：；「」『』（）,.!?:;\"''()\\-—…]+', '', 'g') AS text FROM lines")
def sca3(lines):
    return lines.select("line_id", T.normalize(F.col("source")).alias("text"))


@query("sca4_squeeze", "SELECT line_id, regexp_replace(source, '\\s+', '', 'g') AS text FROM lines")
def sca4(lines):
    return lines.select("line_id", T.squeeze(F.col("source")).alias("text"))


@query("sca5_words", "SELECT line_id, regexp_replace(source, '[^\\p{L}\\p{N}_]+', '', 'g') AS text FROM lines")
def sca5(lines):
    return lines.select("line_id", T.word_characters(F.col("source")).alias("text"))


@query("sca6_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sca6(embeddings):
    b = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return embeddings.join(b, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("sca7_convert_script", "SELECT line_id, translate(source, 'abc', 'xyz') AS text FROM lines")
def sca7(lines):
    return lines.select("line_id", T.convert_script(F.col("source"), "abc", "xyz").alias("text"))


@query("sca8_clock", """
    SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock,
           printf('%d:%02d', s // 60, s % 60) AS short, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt
    FROM (SELECT event_id, CAST(floor(event_id * 1.25) AS BIGINT) AS s, CAST(event_id AS BIGINT) * 1250 AS ms FROM events) x""")
def sca8(events):
    s = F.col("event_id") * F.lit(1.25)
    return events.select("event_id", T.clock(s).alias("clock"), T.minute_second(s).alias("short"), T.vtt_time(s).alias("vtt"))


@query("sca9_speaker_code", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN '' ELSE concat('S', event_id % 5 + 1) END AS code FROM events")
def sca9(events):
    n = F.when(F.col("event_id") % 5 == 4, -1).otherwise(F.col("event_id") % 5)
    return events.select("event_id", T.speaker_code(n).alias("code"))


@query("sca10_budgets", "SELECT doc_id, t AS target_chars, 2 * t + 800 AS max_tokens FROM (SELECT doc_id, least(greatest(n_chars // 6, 400), 8000) AS t FROM documents) x")
def sca10(documents):
    t = T.target_chars(F.col("n_chars"))
    return documents.select("doc_id", t.alias("target_chars"), T.max_tokens(t).alias("max_tokens"))


@query("sca11_item_text", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE concat('item ', event_id) END AS text FROM events")
def sca11(events):
    item = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"text": "'), "event_type", F.lit('", "line": 3}'))).otherwise(F.concat(F.lit("item "), F.col("event_id").cast("string")))
    return events.select("event_id", T.item_text(item).alias("text"))


@query("sca12_mostly_han", """
    SELECT line_id, len(regexp_replace(t, '[^一-鿿]', '', 'g')) * 2 >= len(regexp_replace(t, '[\\s，。、！？：；「」『』（）,.!?:;\"''()\\-—…]+', '', 'g')) AS han
    FROM (SELECT line_id, translate(source, 'etaon', '字單管料號') AS t FROM lines) x""")
def sca12(lines):
    return lines.select("line_id", T.mostly_han(F.translate("source", "etaon", "字單管料號")).alias("han"))


@query("sca14_strip_think", "SELECT line_id, trim(source) AS text FROM lines")
def sca14(lines):
    return lines.select("line_id", T.strip_think(F.concat(F.lit("<think>why\nnot</think>"), "source")).alias("text"))


@query("sca15_first_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS found FROM events")
def sca15(events):
    n = F.col("event_id") % 3
    reply = F.when(n == 0, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(n == 1, F.lit("no object")).otherwise(F.concat(F.lit("{bad "), "props"))
    return events.select("event_id", T.first_json(reply).alias("found"))


@query("sca16_target_languages", """
    SELECT line_id, array_to_string(list_filter(['zh', 'vi', 'en', 'fr'], lambda x: x <> lang), ',') AS targets FROM lines""")
def sca16(lines):
    return lines.select("line_id", F.array_join(T.target_languages(F.array(*map(F.lit, ("zh", "vi", "en", "fr"))), F.col("lang")), ",").alias("targets"))
