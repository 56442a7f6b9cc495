"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs as O
from ..operators import filters, joins, tops
from .registry import query

_NORM = "regexp_replace({}, '[\\s，。、！？：；「」『』（）,.!?:;\"''()\\-—…]+', '', 'g')"
_FILL = ("the", "on", "er")


@query("agg1_session_list", "SELECT s.session_id, count(l.line_id) AS n_lines FROM sessions s LEFT JOIN lines l ON l.session_id = s.session_id AND l.speaker = 'S1' GROUP BY 1")
def agg1(sessions, lines):
    return O.session_list(sessions, lines.where("speaker = 'S1'")).select("session_id", "n_lines")


@query("agg2_dominant_languages", """
    WITH b AS (SELECT session_id, speaker, lang, d, min(event_id) AS seq FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN concat('r', event_id) ELSE CAST(decode AS VARCHAR) END AS d FROM votes WHERE value < 60) y GROUP BY ALL),
    p AS (SELECT session_id, speaker, lang, count(*) AS n, min(seq) AS seq FROM b GROUP BY ALL), t AS (SELECT session_id, lang, sum(n) AS a, min(seq) AS seq FROM p GROUP BY ALL),
    m AS (SELECT session_id, lang AS meeting FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY a DESC, seq) = 1), c AS (SELECT session_id, sum(a) AS ballots FROM t GROUP BY 1),
    x AS (SELECT *, sum(n) OVER (PARTITION BY session_id, speaker) AS mine FROM p QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY n DESC, seq) = 1)
    SELECT u.session_id, u.speaker, CASE WHEN coalesce(x.mine, 0) < 20 OR (x.lang <> m.meeting AND t.a < c.ballots * 0.19) THEN m.meeting ELSE x.lang END AS lang
    FROM (SELECT DISTINCT session_id, speaker FROM votes) u LEFT JOIN x USING (session_id, speaker) JOIN m USING (session_id) JOIN c USING (session_id) LEFT JOIN t ON t.session_id = u.session_id AND t.lang = x.lang""")
def agg2(votes):
    u = votes.withColumn("text", F.when(F.col("value") < 60, F.col("text"))).withColumn("decode", F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.col("decode"))).withColumnRenamed("event_id", "seq")
    return O.dominant_languages(u, 20, 0.19)


@query("agg5_boilerplate_rate", f"""
    WITH w AS (SELECT lang, greatest(1, len({_NORM.format('text')})) AS w, regexp_matches(text, '(?i)all rights reserved') OR regexp_matches(replace(text, ' ', ''), '(?i)all rights reserved') AS f FROM documents)
    SELECT lang, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(CASE WHEN f THEN w ELSE 0 END) AS BIGINT) AS flagged, round(sum(CASE WHEN f THEN w ELSE 0 END) / sum(w), 4) AS rate FROM w GROUP BY ROLLUP (lang)""")
def agg5(documents):
    return O.boilerplate_rate(documents, filters.is_boilerplate(F.col("text"), ("all rights reserved",)))


@query("agg6_talk_share", "SELECT session_id, speaker, CAST(sum(len(source)) AS BIGINT) AS chars, round(sum(len(source)) / sum(sum(len(source))) OVER (PARTITION BY session_id), 6) AS share, sum(len(source)) / sum(sum(len(source))) OVER (PARTITION BY session_id) >= 0.3 AS listed FROM lines GROUP BY 1, 2")
def agg6(lines):
    return O.talk_share(lines, 0.3)[0]


@query("agg6_languages", "SELECT session_id, lang, count(*) AS n_lines, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, lang) = 1 AS main FROM lines GROUP BY 1, 2")
def agg6b(lines):
    return O.talk_share(lines)[1]


@query("agg7_ngram_vocabulary", """
    WITH r AS (SELECT unnest(regexp_extract_all(source, '[a-z]+')) AS run FROM lines), g AS (SELECT substr(run, i, k) AS gram FROM r, unnest([2, 3, 4]) t(k), unnest(range(1, greatest(len(run) - k + 2, 1))) u(i))
    SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def agg7(lines):
    return O.ngram_vocabulary(lines.withColumn("text", F.col("source")), "[a-z]")


@query("agg8_hits_per_session", "SELECT session_id, count(*) AS hits FROM lines WHERE contains(source, 'tion') GROUP BY 1")
def agg8(lines):
    return tops.hits_per_session(lines.where(F.col("source").contains("tion")))


@query("agg9_threshold_sweep", """
    SELECT t AS threshold, count(*) FILTER (WHERE no_speech < t) AS kept, count(*) FILTER (WHERE no_speech < t AND junk) AS junk_kept, count(*) FILTER (WHERE no_speech >= t AND NOT junk) AS clean_dropped
    FROM scored, unnest([0.25, 0.5, 0.75]) x(t) WHERE trim(text) <> '' GROUP BY 1""".replace("[0.25, 0.5, 0.75]", "CAST([0.25, 0.5, 0.75] AS DOUBLE[])"))
def agg9(scored):
    return O.threshold_sweep(scored, [0.25, 0.5, 0.75])


@query("agg10_centroids", """
    WITH v AS (SELECT session_id, vec_id % 7 AS speaker, CAST(vec_id % 13 AS DOUBLE) / 2 AS seconds, centroid FROM voiceprints), g AS (SELECT * FROM v WHERE seconds >= 1),
    t AS (SELECT session_id, speaker, sum(seconds) AS seconds FROM g GROUP BY ALL HAVING sum(seconds) >= 6)
    SELECT t.session_id, t.speaker, t.seconds, round(avg(CAST(centroid[1] AS DOUBLE)), 6) AS first, round(avg(CAST(centroid[64] AS DOUBLE)), 6) AS last FROM t JOIN g USING (session_id, speaker) GROUP BY ALL""")
def agg10(voiceprints):
    v = voiceprints.select("session_id", (F.col("vec_id") % 7).alias("speaker"), ((F.col("vec_id") % 13).cast("double") / 2).alias("seconds"), F.col("centroid").alias("embedding"))
    c = O.centroids(v, 6.0)
    return c.select("session_id", "speaker", "seconds", F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(63)), 6).alias("last"))


_COS = "list_cosine_similarity(CAST(a.centroid AS DOUBLE[]), CAST(b.centroid AS DOUBLE[]))"


@query("agg11_similarity_summary", f"""
    WITH p AS (SELECT round({_COS}, 5) AS score FROM voiceprints a JOIN voiceprints b ON a.session_id < b.session_id WHERE {_COS} >= 0.25)
    SELECT count(*) AS pairs, count(*) FILTER (WHERE score >= 0.35) AS above, min(score) AS low, max(score) AS high, quantile_disc(score, 0.5 ORDER BY score DESC) AS median FROM p""".replace("quantile_disc(score, 0.5 ORDER BY score DESC)", "percentile_disc(0.5) WITHIN GROUP (ORDER BY score DESC)"))
def agg11(voiceprints):
    return O.similarity_summary(joins.cross_meeting_pairs(voiceprints, 0.25).withColumn("score", F.round("score", 5)), 0.35)


def _feats(src: str) -> str:
    return f"""SELECT *, 'F:the' AS feature, (len(text) - len(replace(text, 'the', ''))) // 3 AS n FROM {src} UNION ALL SELECT *, 'F:on', (len(text) - len(replace(text, 'on', ''))) // 2 FROM {src}
    UNION ALL SELECT *, 'F:er', (len(text) - len(replace(text, 'er', ''))) // 2 FROM {src}
    UNION ALL SELECT *, CASE WHEN l < 12 THEN 'LEN:s' WHEN l < 30 THEN 'LEN:m' WHEN l < 60 THEN 'LEN:l' ELSE 'LEN:x' END, 1 FROM (SELECT * FROM {src}) q, (SELECT 1) z
    UNION ALL SELECT *, 'EN:1', CASE WHEN regexp_matches(text, '[A-Za-z]{{2,}}') THEN 1 ELSE 0 END FROM {src} UNION ALL SELECT *, 'NUM:1', CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END FROM {src}"""


_PROFILE = f"""named AS (SELECT l.session_id, l.speaker, n.name, l.source AS text, len(regexp_replace(l.source, '\\s', '', 'g')) AS l FROM lines l JOIN speaker_names n ON n.session_id = l.session_id AND n.code = l.speaker WHERE len(l.source) > 1),
    feats AS ({_feats('named').replace(', (SELECT 1) z', '')}), profile AS (SELECT name, session_id, feature, CAST(sum(n) AS BIGINT) AS n FROM feats WHERE n > 0 GROUP BY ALL)"""
_RANK = f"""{_PROFILE}, test AS (SELECT concat(session_id, ':', speaker) AS test_id, session_id, feature, sum(n) AS cnt FROM feats WHERE n > 0 GROUP BY ALL),
    allp AS (SELECT name, feature, sum(n) AS n FROM profile GROUP BY ALL), tt AS (SELECT DISTINCT test_id, session_id FROM test),
    held AS (SELECT tt.test_id, a.name, a.feature, a.n - coalesce(p.n, 0) AS n FROM tt CROSS JOIN allp a LEFT JOIN profile p ON p.session_id = tt.session_id AND p.name = a.name AND p.feature = a.feature WHERE a.n - coalesce(p.n, 0) > 0),
    vocab AS (SELECT test_id, count(*) AS v FROM (SELECT test_id, feature FROM held UNION SELECT test_id, feature FROM test) q GROUP BY 1), tot AS (SELECT test_id, name, sum(n) AS t FROM held GROUP BY ALL),
    score AS (SELECT tot.test_id, tot.name, sum(test.cnt * ln((coalesce(h.n, 0) + 1) / (tot.t + vocab.v))) AS score FROM tot JOIN vocab USING (test_id) JOIN test USING (test_id) LEFT JOIN held h ON h.test_id = tot.test_id AND h.name = tot.name AND h.feature = test.feature GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(score, 9) DESC, name) AS place FROM score)"""


@query("agg12_wording_profile", f"WITH {_PROFILE} SELECT * FROM profile")
def agg12(lines, speaker_names):
    return O.wording_profile(joins.named_lines(lines, speaker_names), _FILL)


@query("agg13_rank_wording", f"WITH {_RANK} SELECT test_id, name, round(score, 5) AS score FROM ranked")
def agg13(lines, speaker_names):
    named = joins.named_lines(lines, speaker_names)
    tests = named.select(F.concat_ws(":", "session_id", "speaker").alias("test_id"), "session_id", "text")
    return O.rank_wording(O.wording_profile(named, _FILL), tests, _FILL).select("test_id", "name", F.round("score", 5).alias("score"))


@query("agg14_speaker_conflicts", f"""
    WITH {_RANK}, k AS (SELECT session_id, speaker, name, concat(session_id, ':', speaker) AS test_id FROM named GROUP BY ALL HAVING count(*) >= 3),
    b AS (SELECT *, min_by(name, place) OVER (PARTITION BY test_id) AS best, count(*) OVER (PARTITION BY test_id) AS c FROM ranked)
    SELECT k.session_id, k.speaker, k.name, b.best FROM k JOIN b USING (test_id, name) WHERE b.c > 1 AND b.place > 1""")
def agg14(lines, speaker_names):
    return O.speaker_conflicts(joins.named_lines(lines, speaker_names), 3, _FILL).select("session_id", "speaker", "name", "best")


@query("agg15_fragment_codes", """
    WITH m AS (SELECT *, coalesce(lag(speaker) OVER w = speaker, false) OR coalesce(lead(speaker) OVER w = speaker, false) AS i FROM runs WINDOW w AS (PARTITION BY session_id ORDER BY start, line_id))
    SELECT session_id, speaker, count(*) AS n_lines FROM m GROUP BY 1, 2 HAVING count(*) <= 3 AND NOT bool_or(i)""")
def agg15(runs):
    return O.fragment_codes(runs)


@query("agg16_next_speaker_code", "SELECT session_id, concat('S', max(CAST(substr(speaker, 2) AS INT)) + 1) AS code FROM lines GROUP BY 1")
def agg16(lines):
    return O.next_speaker_code(lines)


@query("agg17_coverage", "SELECT session_id, coalesce(round(sum(CASE WHEN line_id % 4 = 0 THEN 25 ELSE 0 END) / sum(25), 6), 0) AS skipped FROM lines GROUP BY 1")
def agg17(lines):
    return O.coverage(lines.select("session_id", (F.col("line_id") % 4 == 0).alias("skipped"), F.lit(25).alias("n_lines")))


@query("agg18_regression_check", "SELECT lang AS metric, CASE WHEN lang <> 'zh' THEN avg(len(source)) - CASE lang WHEN 'en' THEN 1 ELSE -1 END END AS was, avg(len(source)) AS value, lang = 'en' AS worse FROM lines GROUP BY 1")
def agg18(lines):
    now = lines.groupBy(F.col("lang").alias("metric")).agg(F.avg(F.length("source")).alias("value"))
    before = now.where("metric <> 'zh'").withColumn("value", F.col("value") - F.when(F.col("metric") == "en", 1).otherwise(-1))
    return O.regression_check(now, before)


@query("agg19_speech_totals", "SELECT session_id, speaker, count(*) AS n, round(sum(end_time - start), 3) AS seconds, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM lines GROUP BY 1, 2")
def agg19(lines):
    return O.speech_totals(lines)


@query("agg20_clip_cap", "SELECT name, session_id FROM (SELECT DISTINCT name, session_id FROM speaker_names) x QUALIFY row_number() OVER (PARTITION BY name ORDER BY session_id DESC) <= 8")
def agg20(speaker_names):
    return O.clip_cap(speaker_names.select("name", "session_id").distinct())
