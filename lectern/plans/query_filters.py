"""Queries of the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as O
from .registry import query

KEYWORDS = ["tion", " the ", "é"]


@query("flt1_search_lines", """
    SELECT line_id, session_id, start, speaker, source FROM lines JOIN sessions USING (session_id)
    WHERE (contains(translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tion') OR contains(translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the'))
      AND started >= TIMESTAMP '2024-01-11 00:00:00' AND started < TIMESTAMP '2024-12-01 00:00:00'
    ORDER BY session_id DESC, start, line_id LIMIT 400""")
def flt1(lines, sessions):
    return O.search_lines(lines, sessions, ["TION", " the ", "x"], "2024-01-11", "2024-11-30").select("line_id", "session_id", "start", "speaker", "source")


@query("flt2_filter_transcript", """
    SELECT DISTINCT line_id FROM lines LEFT JOIN speaker_names n ON n.session_id = lines.session_id AND n.code = lines.speaker
    LEFT JOIN translations t USING (line_id)
    WHERE contains(lower(source), 'n1') OR contains(lower(coalesce(n.name, speaker)), 'n1') OR contains(lower(coalesce(t.text, '')), 'n1')""")
def flt2(lines, speaker_names, translations):
    from ..operators.joins import lines_with_translations

    return O.filter_transcript(lines_with_translations(lines, translations), speaker_names, "N1").select("line_id")


@query("flt3_filter_corrections", "SELECT id, source AS wrong, lower(source) AS \"right\" FROM terms WHERE contains(lower(source), 'th')")
def flt3(terms):
    return O.filter_corrections(terms.select("id", F.col("source").alias("wrong"), F.lower("source").alias("right")), "TH")


@query("flt4_relevant_terms", "SELECT l.line_id, t.id AS term_id, t.source AS term FROM lines l JOIN terms t ON contains(lower(l.source), lower(t.source))")
def flt4(lines, terms):
    return O.relevant_terms(lines, terms).select("line_id", "term_id", "term")


_NORM = "regexp_replace({}, '[\\s，。、！？：；「」『』（）,.!?:;\"''()\\-—…]+', '', 'g')"


@query("flt5_glossary_hits", f"""
    WITH n AS (SELECT session_id AS corpus, lower({_NORM.format('source')}) AS text FROM lines), t AS (SELECT DISTINCT source AS term FROM terms),
    h AS (SELECT DISTINCT corpus, term FROM n JOIN t ON contains(n.text, lower({_NORM.format('term')})))
    SELECT c.corpus, t.term, h.term IS NOT NULL AS found FROM (SELECT DISTINCT corpus FROM n) c CROSS JOIN t LEFT JOIN h ON h.corpus = c.corpus AND h.term = t.term""")
def flt5(lines, terms):
    return O.glossary_hits(lines.select(F.col("session_id").alias("corpus"), F.col("source").alias("text")), terms)


@query("flt6_allowed_language", "SELECT doc_id, lower(string_split(lang, '-')[1]) IN ('en', 'fr') AS allowed FROM documents")
def flt6(documents):
    return documents.select("doc_id", O.allowed_language(F.concat("lang", F.lit("-XX")), F.array(F.lit("en-US"), F.lit("FR"))).alias("allowed"))


@query("flt7_is_noise", r"""
    SELECT line_id, trim(text) <> '' AND regexp_replace(regexp_replace(text, '[\[(（【][^\])）】]*[\])）】]?', '', 'g'), '[ \t\n\r\-–—.,]', '', 'g') = '' AS noise
    FROM (SELECT line_id, CASE WHEN line_id % 7 = 0 THEN concat('[', source) WHEN line_id % 7 = 1 THEN concat('(', substr(source, 1, 5), ') - ') ELSE source END AS text FROM lines) x""")
def flt7(lines):
    text = F.when(F.col("line_id") % 7 == 0, F.concat(F.lit("["), "source")).when(F.col("line_id") % 7 == 1, F.concat(F.lit("("), F.substring("source", 1, 5), F.lit(") - "))).otherwise(F.col("source"))
    return lines.select("line_id", O.is_noise(text).alias("noise"))


@query("flt8_is_degenerate", """
    WITH t AS (SELECT doc_id, regexp_extract_all(text, '[一-鿿ぁ-ヿ가-힣]|[A-Za-zÀ-ỹ]+') AS k FROM documents)
    SELECT doc_id, CASE WHEN len(list_distinct(k)) = 1 AND len(k) >= 5 THEN true WHEN len(k) < 8 THEN false ELSE len(list_distinct(k)) / len(k) < 0.3 END AS degenerate FROM t""")
def flt8(documents):
    return documents.select("doc_id", O.is_degenerate(F.col("text")).alias("degenerate"))


_BOILER = ("all rights reserved", "licensedunder", "^of\\.")


@query("flt9_is_boilerplate", """
    SELECT doc_id, regexp_matches(text, '(?i)all rights reserved|licensedunder|^of\\.') OR regexp_matches(replace(text, ' ', ''), '(?i)all rights reserved|licensedunder|^of\\.') AS boilerplate FROM documents""".replace("\\\\", "\\"))
def flt9(documents):
    return documents.select("doc_id", O.is_boilerplate(F.col("text"), _BOILER).alias("boilerplate"))


@query("flt10_judge", """
    WITH t AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[一-鿿ぁ-ヿ가-힣]|[A-Za-zÀ-ỹ]+') AS k FROM documents)
    SELECT doc_id, md5(CASE WHEN lang NOT IN ('en', 'de') OR CASE WHEN len(list_distinct(k)) = 1 AND len(k) >= 5 THEN true WHEN len(k) < 8 THEN false ELSE len(list_distinct(k)) / len(k) < 0.3 END
        OR regexp_matches(text, '(?i)all rights reserved|licensedunder') OR regexp_matches(replace(text, ' ', ''), '(?i)all rights reserved|licensedunder')
        OR (trim(text) <> '' AND regexp_replace(regexp_replace(text, '[\\[(（【][^\\])）】]*[\\])）】]?', '', 'g'), '[ \\t\\n\\r\\-–—.,]', '', 'g') = '') THEN '' ELSE text END) AS kept FROM t""".replace("\\\\", "\\"))
def flt10(documents):
    return documents.select("doc_id", F.md5(O.judge(F.col("text"), F.col("lang"), F.array(F.lit("en"), F.lit("de")), _BOILER[:2])).alias("kept"))


@query("flt11_silence_gate", "SELECT doc_id, no_speech FROM scored WHERE coalesce(no_speech, 0) < 0.85")
def flt11(scored):
    return O.silence_gate(scored).select("doc_id", "no_speech")


@query("flt12_mostly_glossary", """
    SELECT line_id, len(w) > 0 AND len(replace(replace(replace(replace(replace(replace(replace(w, 'the', ''), 'tion', ''), 'e', ''), 'a', ''), 'o', ''), 'n', ''), 's', '')) * 3 < len(w) AS mostly
    FROM (SELECT line_id, lower(replace(source, ' ', '')) AS w FROM lines) x""")
def flt12(lines):
    return lines.select("line_id", O.mostly_glossary(F.lower("source"), F.array(*map(F.lit, ("the", "tion", "e", "a", "o", "n", "s")))).alias("mostly"))


@query("flt13_iso_date", """
    SELECT event_id, CASE WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN strftime(try_strptime(s, '%Y-%m-%d'), '%Y-%m-%d') END AS date
    FROM (SELECT event_id, concat('20', CAST(10 + event_id % 25 AS VARCHAR), '-', lpad(CAST(event_id % 15 AS VARCHAR), 2, '0'), '-', lpad(CAST(event_id % 33 AS VARCHAR), CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END, '0')) AS s FROM events) x
    """)
def flt13(events):
    n = F.col("event_id")
    day = F.when(n % 4 == 0, F.substring((n % 33).cast("string"), 1, 1)).otherwise(F.lpad((n % 33).cast("string"), 2, "0"))
    s = F.concat(F.lit("20"), (10 + n % 25).cast("string"), F.lit("-"), F.lpad((n % 15).cast("string"), 2, "0"), F.lit("-"), day)
    return events.select("event_id", O.iso_date(s).alias("date"))


@query("flt14_failed_lines", "SELECT line_id, status FROM lines WHERE status <> 'ok'")
def flt14(lines):
    return O.failed_lines(lines).select("line_id", "status")


@query("flt15_bias_terms", """
    WITH RECURSIVE o AS (SELECT id, source, row_number() OVER (ORDER BY source, id) AS n FROM terms WHERE mode = 'hint'),
    g AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS id
          UNION ALL SELECT o.n, g.used + CASE WHEN g.used + len(o.source) + 1 <= 60 THEN len(o.source) + 1 ELSE 0 END, CASE WHEN g.used + len(o.source) + 1 <= 60 THEN o.id END
          FROM g JOIN o ON o.n = g.n + 1)
    SELECT id, source FROM o WHERE id IN (SELECT id FROM g WHERE id IS NOT NULL)""")
def flt15(terms):
    return O.bias_terms(terms, 60).select("id", "source")


@query("flt16_needs_redecode", """
    WITH u AS (SELECT event_id, session_id, speaker, lang, CASE WHEN event_id % 9 = 0 THEN '' ELSE text END AS text FROM votes),
    c AS (SELECT session_id, speaker, lang, count(*) AS n FROM u GROUP BY ALL),
    d AS (SELECT session_id, speaker, lang FROM c QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY n DESC, lang) = 1),
    f AS (SELECT DISTINCT session_id, speaker, 'view' AS lang FROM u WHERE CAST(speaker AS BIGINT) % 7 = 0)
    SELECT event_id, coalesce(f.lang, d.lang) AS wanted FROM u LEFT JOIN d USING (session_id, speaker) LEFT JOIN f ON f.session_id = u.session_id AND f.speaker = u.speaker
    WHERE u.text = '' OR u.lang <> coalesce(f.lang, d.lang)""")
def flt16(votes):
    from pyspark.sql import Window

    u = votes.withColumn("text", F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("text")))
    c = u.groupBy("session_id", "speaker", "lang").count()
    d = c.withColumn("r", F.row_number().over(Window.partitionBy("session_id", "speaker").orderBy(F.desc("count"), "lang"))).where("r = 1")
    f = u.where(F.col("speaker").cast("long") % 7 == 0).select("session_id", "speaker", F.lit("view").alias("lang")).distinct()
    return O.needs_redecode(u, d, f).select("event_id", "wanted")
