"""Prompts as rows, and checks of what a model replied."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import correction as C
from ..functions import text as T
from .occurrences import occurrences

SECTIONS = ("TITLE", "SUMMARY", "DECISIONS", "ACTIONS", "RISKS", "OPEN_QUESTIONS")


def accept(proposals: DataFrame, terms: DataFrame | None = None, key_of=lambda c: c, change: float = 0.30, moved: float = 0.20, most: int = 3, term_moved: float = 0.55) -> DataFrame:
    """proposals (original, candidate) with ``accepted``: is the candidate a correction and not a rewrite.

    It must differ in more than spacing and by few edits. Its sound may move little, unless it brings in a glossary
    term; then each such term is held against the text it stands for.
    """
    new = F.trim("candidate")
    p = proposals.withColumn("_c", F.coalesce(new, F.lit("")))
    size = (F.col("_c") != "") & (F.col("_c") != F.col("original")) & (T.squeeze(F.col("_c")) != T.squeeze(F.col("original")))
    size = size & (F.levenshtein("original", "_c") <= F.greatest(F.lit(2), F.floor(F.length("original") * change)))
    a, b = key_of(F.col("original")), key_of(F.col("_c"))
    near = F.levenshtein(a, b) <= F.least(F.length(a) * moved, F.lit(most))
    plain = F.when((a == "") | (b == ""), True).otherwise(near)
    p = p.withColumn("_size", F.coalesce(size, F.lit(False))).withColumn("_plain", plain).withColumn("_silent", (a == "") | (b == ""))
    if terms is None:
        return p.withColumn("accepted", F.col("_size") & F.col("_plain")).drop("_c", "_size", "_plain", "_silent")

    @F.pandas_udf("string")
    def stood(before: pd.Series, after: pd.Series, term: pd.Series) -> pd.Series:
        return pd.Series([C.replaced_by(x, y, t) for x, y, t in zip(before, after, term, strict=True)])

    # The verdict is of the two texts alone, so equal proposals share it.
    asked = p.where("_size AND NOT _silent").select("original", "_c").distinct()
    held = occurrences(asked.select(F.col("_c").alias("text")), terms.select(F.col("source").alias("term"))).select(F.col("text").alias("_c"), F.col("term").alias("_term"))
    brought = asked.join(held, "_c").where(~F.col("original").contains(F.col("_term")))
    brought = brought.withColumn("_was", stood("original", "_c", "_term"))
    x, y = key_of(F.col("_was")), key_of(F.col("_term"))
    far = F.levenshtein(x, y)
    alike = (x != "") & (y != "") & ((far <= 2) | (far / F.greatest(F.length(x), F.length(y)) <= term_moved))
    judged = brought.groupBy("original", "_c").agg(F.every(alike).alias("_alike"))
    joined = p.join(judged, ["original", "_c"], "left")
    return joined.withColumn("accepted", F.col("_size") & F.when(F.col("_alike").isNull(), F.col("_plain")).otherwise(F.col("_alike"))).drop("_c", "_size", "_plain", "_silent", "_alike")


def numbered_rows(replies: DataFrame) -> DataFrame:
    """(reply columns but the text, index, text) of rows ``n: text``; of one number the last row counts."""
    rows = replies.select("*", F.posexplode(F.split("reply", r"\r?\n")).alias("_row", "_text")).withColumn("index", F.regexp_extract("_text", r"^\s*([0-9]{1,6})\s*[:：.、]\s*(.*)$", 1).try_cast("int"))
    rows = rows.where("index IS NOT NULL").withColumn("text", F.trim(F.regexp_extract("_text", r"^\s*([0-9]{1,6})\s*[:：.、]\s*(.*)$", 2)))
    keys = [c for c in replies.columns if c != "reply"]
    return rows.groupBy(*keys, "index").agg(F.max_by("text", "_row").alias("text"))


def audit_refine(replies: DataFrame, lines: DataFrame, terms: DataFrame | None = None, key_of=lambda c: c, script: tuple[str, str] = ("", "")) -> DataFrame:
    """Lines with ``refined_text``, ``refused`` (the proposal turned down) and ``skipped`` (its chunk was rewritten wholesale).

    replies: session_id, chunk, reply; lines: with chunk and place from 1. Lines already refined are not rewritten.
    """
    size = lines.groupBy("session_id", "chunk").agg(F.count("*").alias("_size"))
    got = numbered_rows(replies.select("session_id", "chunk", "reply")).join(size, ["session_id", "chunk"]).where((F.col("index") >= 1) & (F.col("index") <= F.col("_size")))
    n = Window.partitionBy("session_id", "chunk")
    got = got.withColumn("_got", F.count("*").over(n)).withColumn("_skip", (F.col("_size") >= 4) & (F.col("_got") > F.floor(F.col("_size") / 2)))
    named = got.select("session_id", "chunk", F.col("index").alias("place"), F.col("text").alias("candidate"), "_skip")
    asked = lines.join(named, ["session_id", "chunk", "place"], "left").withColumn("original", F.col("source"))
    judged = accept(asked.where("candidate IS NOT NULL AND NOT _skip"), terms, key_of).select("line_id", "accepted")
    out = asked.join(judged, "line_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)) & ~F.col("refined"))
    skips = got.where("_skip").select("session_id", "chunk", F.lit(True).alias("skipped")).distinct()
    out = out.join(skips, ["session_id", "chunk"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    new = F.when(F.col("lang").startswith("zh"), T.convert_script(F.trim("candidate"), *script)).otherwise(F.trim("candidate"))
    refused = F.when(~F.col("accepted") & ~F.col("skipped") & (F.trim("candidate") != "") & (F.trim("candidate") != F.col("source")), F.trim("candidate"))
    return out.withColumn("refined_text", F.when(F.col("accepted"), new).otherwise(F.col("source"))).withColumn("refused", refused).drop("candidate", "original", "_skip", "accepted")


def audit_groups(replies: DataFrame, pieces: DataFrame) -> DataFrame:
    """(session_id, run, first, last, text) of replies whose ranges tile the run in order and leave its words as they are.

    replies: session_id, run, reply; pieces: session_id, run, place (from 1), source. A run with any fault has no row.
    """
    pattern = r"^([0-9]{1,6})\s*(?:[-–~]\s*([0-9]{1,6}))?\s*[:：]\s*(.+)$"
    rows = replies.select("session_id", "run", F.posexplode(F.split("reply", r"\r?\n")).alias("_row", "_t")).withColumn("_t", F.trim("_t")).where(F.col("_t").rlike(pattern))
    part = lambda k: F.regexp_extract("_t", pattern, k)
    rows = rows.select("session_id", "run", "_row", part(1).try_cast("int").alias("first"), F.coalesce(part(2).try_cast("int"), part(1).try_cast("int")).alias("last"), F.trim(part(3)).alias("text"))
    key = ["session_id", "run"]
    w = Window.partitionBy(*key).orderBy("_row")
    rows = rows.withColumn("_ok", (F.col("first") == F.coalesce(F.lag("last").over(w), F.lit(0)) + 1) & (F.col("last") >= F.col("first"))).withColumn("_end", F.max("last").over(Window.partitionBy(*key)))
    n = pieces.groupBy(*key).agg(F.count("*").alias("_n"))
    words = rows.join(pieces.select(*key, "place", "source"), key).where("place BETWEEN first AND last").groupBy(*key, "_row").agg(T.word_characters(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]), "")).alias("_words"))
    judged = rows.join(words, [*key, "_row"], "left").join(n, key).withColumn("_ok", F.col("_ok") & (F.col("_end") == F.col("_n")) & (T.word_characters(F.col("text")) == F.coalesce("_words", F.lit(""))))
    good = judged.groupBy(*key).agg(F.every("_ok").alias("_all")).where("_all")
    return judged.join(good.select(*key), key, "left_semi").select(*key, "first", "last", "text")


def audit_punctuation(replies: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with ``punctuated``: the reply where only its punctuation differs and the line is not refined."""
    got = numbered_rows(replies.select("session_id", "chunk", "reply")).select("session_id", "chunk", F.col("index").alias("place"), F.col("text").alias("_c"))
    out = lines.join(got, ["session_id", "chunk", "place"], "left")
    same = (F.trim("_c") != "") & (T.word_characters(F.col("_c")) == T.word_characters(F.col("source"))) & ~F.col("refined")
    return out.withColumn("punctuated", F.when(F.coalesce(same, F.lit(False)), F.col("_c")).otherwise(F.col("source"))).drop("_c")


def audit_summary(replies: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: session_id, section, item, text, speaker, line_id; reports: session_id, title, summary, accepted).

    A reply needs a title and a summary. An item cites by ``|| id`` or a closing ``[id]``; an id that is no line of the
    meeting becomes null and a speaker that is not in it blank, and the text stays.
    """
    head = rf"(?i)^\s*({'|'.join(SECTIONS)})\s*:\s*(.*)$"
    rows = replies.select("session_id", F.posexplode(F.split("reply", r"\r?\n")).alias("_row", "_t"))
    w = Window.partitionBy("session_id").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    named = F.upper(F.regexp_extract("_t", head, 1))
    rows = rows.withColumn("section", F.last(F.when(named != "", named), ignorenulls=True).over(w)).withColumn("_t", F.when(named != "", F.regexp_extract("_t", head, 2)).otherwise(F.col("_t"))).where("section IS NOT NULL")
    text = rows.where("section IN ('TITLE', 'SUMMARY')").groupBy("session_id", "section").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_row", "_t"))), lambda x: x["_t"]), "\n")).alias("text"))
    report = text.groupBy("session_id").agg(F.max(F.when(F.col("section") == "TITLE", F.col("text"))).alias("title"), F.max(F.when(F.col("section") == "SUMMARY", F.col("text"))).alias("summary"))
    report = replies.select("session_id").distinct().join(report, "session_id", "left").withColumn("accepted", (F.coalesce("title", F.lit("")) != "") & (F.coalesce("summary", F.lit("")) != ""))
    bullet = F.trim(F.regexp_replace(F.trim("_t"), r"^[-•*]", ""))
    items = rows.where("section NOT IN ('TITLE', 'SUMMARY')").withColumn("_b", bullet).where("_b <> ''").join(report.where("accepted").select("session_id"), "session_id", "left_semi")
    bars = r"(?s)^(.*)\|\|\s*\[?#?(-?[0-9]{1,15})\]?\s*$"
    tail = r"[\s(（]*\[([0-9]{1,15})\](?:\s*[-–~]\s*\[?[0-9]+\]?)?[)）\s。，,.、]*$"
    cited = F.coalesce(F.regexp_extract("_b", bars, 2).try_cast("long"), F.when(~F.col("_b").contains("||") | (F.col("section") == "ACTIONS"), F.regexp_extract("_b", tail, 1).try_cast("long")))
    known = lines.select(F.col("session_id").alias("_ks"), F.col("line_id").alias("_known"))
    checked = items.withColumn("_cited", cited).join(known, (F.col("session_id") == F.col("_ks")) & (F.col("_cited") == F.col("_known")), "left").drop("_ks")
    by_bars = F.col("_b").rlike(bars)
    listed = F.trim(F.regexp_replace("_b", r"\|\|[^|]*$", ""))
    closed = F.when(F.col("_known").isNotNull(), F.rtrim(F.regexp_replace("_b", tail, ""))).otherwise(F.col("_b"))
    other = F.when(F.col("_b").contains("||"), listed).otherwise(closed)
    action = F.when(by_bars & F.col("_known").isNotNull(), F.trim(F.regexp_extract("_b", bars, 1))).otherwise(closed)
    body = F.when(F.col("section") == "ACTIONS", action).otherwise(other)
    split = checked.withColumn("_body", body).withColumn("text", F.when(F.col("section") == "ACTIONS", F.trim(F.regexp_extract("_body", r"(?s)^(.*?)(?:\|\|.*)?$", 1))).otherwise(F.trim("_body")))
    who = F.when(F.col("section") == "ACTIONS", F.trim(F.regexp_extract("_body", r"(?s)\|\|(.*)$", 1)))
    speakers = lines.select(F.col("session_id").alias("_s"), F.col("speaker").alias("_who")).distinct()
    split = split.withColumn("_named", who).where("text <> ''")
    out = split.join(speakers, (F.col("session_id") == F.col("_s")) & (F.col("_named") == F.col("_who")), "left")
    return out.select("session_id", "section", F.col("_row").alias("item"), "text", F.when(F.col("section") == "ACTIONS", F.coalesce("_who", F.lit(""))).alias("speaker"), F.col("_known").alias("line_id")), report


def audit_translation(replies: DataFrame) -> DataFrame:
    """replies (…, reply, targets array<string>) with accepted, translations, previous_source, previous_translations."""
    body = T.first_json(F.col("reply"))
    kept = lambda path: F.map_filter(F.coalesce(F.from_json(F.get_json_object(body, path), "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains("targets", k))
    out = replies.withColumn("accepted", body.isNotNull()).withColumn("translations", kept("$.translations")).withColumn("previous_translations", kept("$.previous.translations")).withColumn("previous_source", F.get_json_object(body, "$.previous.source"))
    empty = (F.coalesce("previous_source", F.lit("")) == "") & (F.size("previous_translations") == 0)
    return out.withColumn("previous_source", F.when(~empty, F.col("previous_source"))).withColumn("previous_translations", F.when(~empty, F.col("previous_translations")))


def audit_keywords(replies: DataFrame) -> DataFrame:
    """replies with keywords (trimmed, two characters and more, no repeats), since and until; a bad reply gives none."""
    from .filters import iso_date

    body = T.first_json(F.col("reply"))
    # Values that are not strings keep no quotes in the raw array.
    raw = F.from_json(F.get_json_object(body, "$.keywords"), "array<variant>")
    words = F.filter(F.transform(raw, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string")))), lambda x: x.isNotNull() & (F.length(x) >= 2))
    none = F.array().cast("array<string>")
    return replies.withColumn("keywords", F.array_distinct(F.coalesce(words, none))).withColumn("since", iso_date(F.get_json_object(body, "$.since"))).withColumn("until", iso_date(F.get_json_object(body, "$.until")))


def audit_sessions(replies: DataFrame, known: DataFrame) -> DataFrame:
    """(reply_id, place, session_id): the meetings a reply picked that exist, each once, in its order."""
    ids = F.from_json(F.get_json_object(T.first_json(F.col("reply")), "$.sessions"), "array<string>")
    rows = replies.select("reply_id", F.posexplode(ids).alias("place", "_id")).withColumn("session_id", F.trim("_id").try_cast("long"))
    once = rows.groupBy("reply_id", "session_id").agg(F.min("place").alias("place"))
    return once.join(known.select("session_id").distinct(), "session_id", "left_semi").select("reply_id", "place", "session_id")


def prompt_rows(lines: DataFrame, terms: DataFrame, template: str, size: int = 25, context: int = 3, note: Column | None = None) -> DataFrame:
    """(session_id, chunk, prompt): one request per chunk. The template has {terms}, {context}, {lines} and {note}."""
    from .filters import relevant_terms
    from .windows import chunks

    parts = chunks(lines, size)
    asked = parts.groupBy("session_id", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "source"))), lambda x: F.concat_ws(": ", x["place"].cast("string"), x["source"])), "\n").alias("_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]), "\n").alias("_text"),
        F.slice(F.sort_array(F.collect_list(F.struct(F.col("place"), F.col("source"))), asc=False), 1, context).alias("_last"),
    )
    found = relevant_terms(parts, terms.where("mode <> 'hint'")).groupBy("session_id", "chunk").agg(F.array_join(F.sort_array(F.collect_set("term")), ", ").alias("_terms"))
    before = F.lag("_last").over(Window.partitionBy("session_id").orderBy("chunk"))
    text = F.coalesce(F.array_join(F.transform(F.reverse(before), lambda x: x["source"]), "\n"), F.lit(""))
    filled = asked.withColumn("_context", text).join(found, ["session_id", "chunk"], "left")
    prompt = F.lit(template)
    for key, value in (("{terms}", F.coalesce("_terms", F.lit(""))), ("{context}", F.col("_context")), ("{note}", note if note is not None else F.lit("")), ("{lines}", F.col("_lines"))):
        prompt = F.replace(prompt, F.lit(key), value)
    return filled.select("session_id", "chunk", prompt.alias("prompt"))


def summary_status(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, status): ok, partial or failed by how many wanted languages (session_id, lang) parsed; no_llm without replies."""
    got = results.groupBy("session_id", "lang").agg(F.bool_or("parsed").alias("_ok"))
    n = wanted.join(got, ["session_id", "lang"], "left").groupBy("session_id").agg(F.count("*").alias("_w"), F.count_if(F.coalesce("_ok", F.lit(False))).alias("_k"), F.count("_ok").alias("_r"))
    return n.select("session_id", F.when(F.col("_r") == 0, "no_llm").when(F.col("_k") == F.col("_w"), "ok").when(F.col("_k") > 0, "partial").otherwise("failed").alias("status"))
