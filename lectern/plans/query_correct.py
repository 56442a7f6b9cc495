"""Queries of correction and learning. Letters stand in for Han, of which the driver's tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, audits
from ..operators import correct as O
from .registry import query

LETTERS = "[a-z]"


def key_of(text):
    """Readings for the queries: c sounds as k, z as s, and double letters as one."""
    return F.translate(text, "cz", "ks")


def readings(spark):
    rows = [(c, {"c": "k", "z": "s"}.get(c, c), c) for c in "abcdefghijklmnopqrstuvwxyz"]
    return spark.createDataFrame(rows, "char string, toneless string, toned string")


def pairs_of(terms):
    return terms.where("id % 2 = 0").select(F.substring("source", 1, 4).alias("wrong"), F.upper(F.substring("source", 1, 4)).alias("right")).distinct()


@query("cor1_apply_aliases")
def cor1(lines, terms):
    return O.corrected(lines, terms, pairs_of(terms), parts=("aliases",)).select("line_id", "fixed")


@query("cor2_term_rules", """
    SELECT id, source AS term, lower(source) AS key, false AS by_sound, CASE WHEN len(source) < 6 THEN 0 ELSE CAST(floor(len(source) * 0.25) AS INT) END AS most FROM terms WHERE mode <> 'protect' AND len(source) >= 4""")
def cor2(terms):
    return O.term_rules(terms)


@query("cor3_fix_homophones")
def cor3(lines, terms):
    low = terms.withColumn("source", F.lower("source"))
    return O.corrected(lines, low, None, readings(lines.sparkSession), LETTERS, ("sound",)).select("line_id", "fixed")


@query("cor4_fix_latin", """
    WITH r AS (SELECT id, source AS term, lower(source) AS key, CASE WHEN len(source) < 6 THEN 0 ELSE CAST(floor(len(source) * 0.25) AS INT) END AS most FROM terms WHERE mode <> 'protect' AND len(source) >= 4),
    p AS (SELECT line_id, regexp_replace(source, '[^ -~]', '', 'g') AS s FROM lines),
    t AS (SELECT line_id, regexp_extract_all(s, '[A-Za-z][A-Za-z''-]*') AS toks FROM p), w AS (SELECT DISTINCT unnest(toks) AS token FROM t),
    b AS (SELECT token, term FROM w JOIN r ON levenshtein(lower(token), key) <= most QUALIFY row_number() OVER (PARTITION BY token ORDER BY len(term) DESC, term, id) = 1)
    SELECT line_id, count(*) AS n_tokens, count(b.term) AS n_fixed, string_agg(DISTINCT b.term, ',' ORDER BY b.term) AS terms FROM (SELECT line_id, unnest(toks) AS token FROM t) x LEFT JOIN b USING (token) GROUP BY 1""")
def cor4(lines, terms):
    rules = O.term_rules(terms)
    plain = lines.withColumn("source", F.regexp_replace("source", "[^ -~]", ""))
    fixed = O.fix_latin(plain, rules)
    token = r"[A-Za-z][A-Za-z'-]*"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col("source"), F.lit(token), F.lit(0)).alias("a"), F.regexp_extract_all(F.col("fixed"), F.lit(token), F.lit(0)).alias("b"))
    each = fixed.select("line_id", F.explode(pairs).alias("p"))
    hit = each.join(rules.select("term", "key", "most"), F.col("p.b") == F.col("term"), "left")
    near = F.when(F.levenshtein(F.lower("p.a"), F.col("key")) <= F.col("most"), F.col("term"))
    one = hit.groupBy("line_id", "p").agg(F.count("*").alias("_m"), F.max(near).alias("term"), F.first("p").alias("_p"))
    n = each.groupBy("line_id", "p").agg(F.count("*").alias("k"))
    joined = n.join(one.select("line_id", "p", "term"), ["line_id", "p"])
    names = F.array_join(F.sort_array(F.collect_set("term")), ",")
    return joined.groupBy("line_id").agg(F.sum("k").alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("k"))), F.lit(0)).alias("n_fixed"), F.when(F.count("term") > 0, names).alias("terms"))


@query("cor5_correct_lines")
def cor5(lines, terms):
    return O.corrected(lines, terms, pairs_of(terms), readings(lines.sparkSession), "[à-ÿ]").select("line_id", "fixed")


@query("cor6_term_collisions", """
    WITH w AS (SELECT substr(source, i, 5) AS w FROM lines, unnest(range(1, len(source) - 3)) t(i) WHERE len(source) >= 5)
    SELECT w AS "window", count(*) AS n FROM w WHERE regexp_full_match(w, '[a-z]{5}') AND w <> 'ation' AND translate(w, 'eiou', 'aaaa') = 'ataan' AND w NOT IN (SELECT source FROM terms) GROUP BY 1""")
def cor6(lines, terms):
    return O.term_collisions("ation", lines, terms, lambda t: F.translate(t, "eiou", "aaaa"), LETTERS)


def proposals(edits):
    first = edits.where("n = 0").select("line_id", F.col("text").alias("original"))
    return first.withColumn("candidate", F.regexp_replace("original", "th", "dh"))


@query("cor7_diff_terms")
def cor7(edits):
    p = proposals(edits)
    return p.select("line_id", F.explode(O.diff_terms(F.col("original"), F.col("candidate"), "[a-zA-Z]")).alias("d")).select("line_id", "d.wrong", "d.right")


@query("cor8_learn_corrections")
def cor8(terms):
    word = F.lower(F.substring("source", 1, 3))
    events = terms.select(F.col("id").alias("seq"), word.alias("a"), F.lower(F.substring("source", 2, 3)).alias("b"), "lang")
    events = events.select("seq", F.when(F.col("seq") % 3 == 0, F.col("b")).otherwise(F.col("a")).alias("wrong"), F.when(F.col("seq") % 3 == 0, F.col("a")).otherwise(F.col("b")).alias("right"), "lang")
    return O.learn_corrections(events)


@query("cor9_mine_terms")
def cor9(edits, terms):
    return O.mine_terms(proposals(edits), terms, key_of, 2, 0.9, "[a-zA-Z]")


@query("cor10_score_corrections")
def cor10(lines, terms):
    pairs = O.corrected(lines, terms, pairs_of(terms)).select(F.col("source").alias("before"), F.col("fixed").alias("after"))
    vocab = aggs.ngram_vocabulary(lines.withColumn("text", F.lower("source")), LETTERS)
    return O.score_changes(pairs, vocab, letters="[a-zA-Z]")


@query("cor11_score_guards")
def cor11(edits, lines, terms):
    p = proposals(edits)
    judged = audits.accept(p, terms, key_of).select(F.col("original").alias("before"), F.col("candidate").alias("after"), "accepted")
    vocab = aggs.ngram_vocabulary(lines.withColumn("text", F.lower("source")), LETTERS)
    return O.score_guards(judged, vocab, lines.withColumn("text", F.col("source")), letters="[a-zA-Z]")


@query("cor12_edit_correction", """
    WITH c AS (SELECT DISTINCT substr(source, 1, 4) AS wrong FROM terms WHERE id % 2 = 0), e AS (SELECT id, substr(source, 1, 4) AS key, CASE WHEN id % 5 = 0 THEN '' ELSE lower(substr(source, 1, 4)) END AS wrong, CASE WHEN id % 7 = 0 THEN lower(substr(source, 1, 4)) ELSE 'x' END AS "right" FROM terms)
    SELECT id, CASE WHEN key NOT IN (SELECT wrong FROM c) THEN 'unknown' WHEN wrong = '' OR "right" = '' THEN 'blank' WHEN wrong = "right" THEN 'itself' WHEN wrong IN (SELECT wrong FROM c) AND wrong <> key THEN 'taken' END AS reason FROM e
    WHERE reason IS NOT NULL""")
def cor12(terms):
    low = F.lower(F.substring("source", 1, 4))
    edits = terms.select("id", F.substring("source", 1, 4).alias("key"), F.when(F.col("id") % 5 == 0, "").otherwise(low).alias("wrong"), F.when(F.col("id") % 7 == 0, low).otherwise("x").alias("right"))
    return O.edit_correction(pairs_of(terms), edits)[1].select("id", "reason")
