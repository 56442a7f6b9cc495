"""Filters and predicates over lines, terms and decoded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .common import small
from .occurrences import occurrences

#: Phrases of subtitle boilerplate (fixed values; patterns, matched without case). A deployment may pass its own.
BOILERPLATE = (
    r"đăng ký kênh", r"theo dõi và (hẹn|đăng)", r"hẹn gặp lại", r"subscribe cho kênh", r"la la school",
    r"thank(s| you) for watching", r"subscribe to (our|the) channel", r"please subscribe",
    r"^thank you( very much)?[.!]?$", r"^see you next time[.!]?$",
    r"小鈴鐺",
    r"訂閱(我們的)?頻道", r"點選訂閱", r"歡迎訂閱", r"請不吝", r"點贊", r"打賞", r"明鏡", r"點點欄目",
    r"ming pao", r"amara\.org", r"字幕(組|小組)", r"字幕由", r"本期的?(影片|視頻|節目)", r"謝謝觀看", r"感謝觀看",
    r"^中文字幕(提供)?$",
    r"歡迎收[看睇]", r"感謝收[看睇]", r"本集(?!團).{0,4}(完|結束|到此)", r"本期(完|播放)", r"本節目", r"下部節目",
    r"(請您|敬請|歡迎)關注", r"(謝謝|感謝|多謝)[^。！!]{0,4}(收[看睇]|觀看)",
    r"^剪輯[·:：]?[一-鿿]{2,3}$",
    r"(下次|下期|下集|下回)再?見(再見|囉)?[。！!]?$", r"多多支援", r"請按贊", r"支持明鏡",
)


def search_lines(lines: DataFrame, sessions: DataFrame, keywords: list[str], since: str | None = None, until: str | None = None, limit: int = 400) -> DataFrame:
    """Lines with any keyword, of meetings in the dates, newest meeting first, then by start.

    Keywords are trimmed; those under two characters do not count, and with none left nothing is found.
    """
    wanted = [k.strip() for k in keywords if len(k.strip()) >= 2]
    if not wanted:
        return lines.limit(0)
    folded = T.ascii_fold(F.col("source"))
    found = lines.where(T.any_of([folded.contains(T.ascii_fold(F.lit(k))) for k in wanted]))
    dated = sessions.select("session_id", F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss").alias("_at"))
    if since:
        dated = dated.where(F.col("_at") >= since)
    if until:
        dated = dated.where(F.col("_at") <= until + "T23:59:59")
    return found.join(dated.select("session_id"), "session_id").orderBy(F.desc("session_id"), "start", "line_id").limit(limit)


def filter_transcript(lines: DataFrame, names: DataFrame, q: str) -> DataFrame:
    """Lines whose text, speaker's name or any translation contains q, without case."""
    q = q.lower()
    who = names.select("session_id", F.col("code").alias("speaker"), F.col("name").alias("_name"))
    named = lines.join(who, ["session_id", "speaker"], "left")
    hit = F.lower("source").contains(q) | F.coalesce(F.lower(F.coalesce("_name", "speaker")).contains(q), F.lit(False))
    other = F.exists(F.map_values(F.coalesce("translations", F.create_map().cast("map<string,string>"))), lambda t: F.coalesce(F.lower(t).contains(q), F.lit(False)))
    return named.where(hit | other).drop("_name")


def filter_corrections(corrections: DataFrame, q: str) -> DataFrame:
    return corrections.where(F.lower("wrong").contains(q.lower()) | F.lower("right").contains(q.lower()))


def relevant_terms(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(line columns, term_id, term): terms whose text a line contains, without case."""
    low = F.lower("source").alias("_low")
    named = terms.where("source <> ''").select(F.col("id").alias("term_id"), F.col("source").alias("term"), low)
    hits = occurrences(lines.select(F.lower("source").alias("text")), named.select(F.col("_low").alias("term"))).select(F.col("text").alias("_text"), F.col("term").alias("_low"))
    return lines.join(hits, F.lower(lines["source"]) == F.col("_text")).join(named, "_low").select(*(lines[c] for c in lines.columns), "term_id", "term")


def glossary_hits(corpora: DataFrame, terms: DataFrame) -> DataFrame:
    """(corpus, term, found): every term against every corpus, on normalised lower-case text.

    A corpus is many lines; a term that runs over a line's end is not found.
    """
    key = lambda c: F.lower(T.normalize(c))
    few = terms.select(F.col("source").alias("term"), key(F.col("source")).alias("_key")).distinct()
    said = corpora.select("corpus", key(F.col("text")).alias("_text")).distinct()
    found = occurrences(said.select(F.col("_text").alias("text")), few.select(F.col("_key").alias("term"))).select(F.col("text").alias("_text"), F.col("term").alias("_key"))
    hits = said.join(found, "_text").select("corpus", "_key").distinct().join(few, "_key").select("corpus", "term")
    # Every text holds the empty term; and the question asks for each corpus with each term.
    hits = hits.unionByName(said.where("_text IS NOT NULL").select("corpus").distinct().join(few.where("_key = ''").select("term"))).distinct()
    every = corpora.select("corpus").distinct().join(small(few.select("term")))
    return every.join(hits.withColumn("found", F.lit(True)), ["corpus", "term"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def allowed_language(lang: Column, configured: Column) -> Column:
    base = lambda x: F.lower(F.split(x, "-")[0])
    return (F.size(configured) == 0) | F.coalesce(lang == "", F.lit(True)) | F.array_contains(F.transform(configured, base), base(lang))


def is_noise(text: Column) -> Column:
    left = F.regexp_replace(text, r"[\[(（【][^\])）】]*[\])）】]?", "")
    return (F.trim(F.regexp_replace(text, r"(?U)\s", "")) != "") & (F.regexp_replace(left, r"[ \t\n\r\-–—.,]", "") == "")


#: One character of Han, kana or hangul, or one Latin word (fixed pattern).
TOKEN = r"[\x{4e00}-\x{9fff}\x{3041}-\x{30ff}\x{ac00}-\x{d7a3}]|[A-Za-z\x{c0}-\x{1ef9}]+"


def is_degenerate(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    n, kinds = F.size(tokens), F.size(F.array_distinct(tokens))
    return F.when((kinds == 1) & (n >= 5), True).when(n < 8, False).otherwise(kinds / n < 0.3)


def is_boilerplate(text: Column, phrases: tuple[str, ...] = BOILERPLATE, script: tuple[str, str] = ("", "")) -> Column:
    """Any phrase in the text as it is, in the other script, or in either without spaces."""
    other = T.convert_script(text, *script)
    forms = F.array(text, other, F.replace(text, F.lit(" ")), F.replace(other, F.lit(" ")))
    return F.exists(forms, lambda f: f.rlike("(?iu)" + "|".join(phrases)))


def judge(text: Column, lang: Column, configured: Column, phrases: tuple[str, ...] = BOILERPLATE, script: tuple[str, str] = ("", "")) -> Column:
    bad = is_noise(text) | is_degenerate(text) | is_boilerplate(text, phrases, script) | ~allowed_language(lang, configured)
    return F.when(bad, F.lit("")).when(F.lower(F.split(lang, "-")[0]) == "zh", T.convert_script(text, *script)).otherwise(text)


def silence_gate(segments: DataFrame, biased: bool = False, most: float = 0.85) -> DataFrame:
    return segments if biased else segments.where(F.coalesce("no_speech", F.lit(0.0)) < most)


def mostly_glossary(text: Column, terms: Column) -> Column:
    """True if less than a third of the text is left once every term is taken out."""
    bare = F.replace(text, F.lit(" "))
    left = F.aggregate(terms, bare, lambda t, term: F.when(term == "", t).otherwise(F.replace(t, F.replace(term, F.lit(" ")))))
    return (F.length(bare) > 0) & (F.length(left) * 3 < F.length(bare))


def iso_date(s: Column) -> Column:
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.date_format(F.try_to_date(s, "yyyy-MM-dd"), "yyyy-MM-dd"))


def failed_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("status") != "ok")


def bias_terms(terms: DataFrame, budget: int = 200) -> DataFrame:
    """Hint terms in source order that fit the budget; one that does not fit is passed over. A glossary is one short list."""
    sorted_ = terms.where("mode = 'hint'").agg(F.sort_array(F.collect_list(F.struct("source", "id"))).alias("all"))
    kept = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("ids")),
        lambda a, t: F.when(
            a["used"] + F.length(t["source"]) + 1 <= budget,
            F.struct((a["used"] + F.length(t["source"]) + 1).alias("used"), F.array_append(a["ids"], t["id"]).alias("ids")),
        ).otherwise(a),
        lambda a: a["ids"],
    )
    return terms.join(sorted_.select(F.explode(kept).alias("id")), "id", "left_semi")


def needs_redecode(utts: DataFrame, dominant: DataFrame, forced: DataFrame) -> DataFrame:
    """Utterances to decode again: a language is wanted (forced, else the majority's) and text is empty or in another."""
    wanted = utts.join(dominant.select("session_id", "speaker", F.col("lang").alias("_major")), ["session_id", "speaker"], "left")
    wanted = wanted.join(forced.select("session_id", "speaker", F.col("lang").alias("_forced")), ["session_id", "speaker"], "left")
    wanted = wanted.withColumn("wanted", F.coalesce("_forced", "_major")).drop("_major", "_forced")
    return wanted.where(F.col("wanted").isNotNull() & ((F.coalesce("text", F.lit("")) == "") | ~F.col("lang").eqNullSafe(F.col("wanted"))))
