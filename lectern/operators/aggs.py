"""Aggregates: votes, shares, error rates, wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import cut_lineage, first_per, small

#: Words that mark a manner of speaking (fixed values). A deployment may pass its own.
FILLERS = (
    "那個", "然後", "就是", "對不對", "我覺得", "其實", "反正", "基本上", "所以說",
    "你知道", "這樣子", "的話", "一個", "問題", "OK", "齁", "啦", "喔", "欸", "嘛",
    "呢", "吧", "嗯", "我們", "你們", "他們", "現在", "如果", "因為", "但是", "可是",
    "而且", "比如", "譬如", "包括", "應該", "可能", "一定", "真的", "當然", "其他",
)


def session_list(sessions: DataFrame, lines: DataFrame) -> DataFrame:
    n = lines.groupBy("session_id").agg(F.count("*").alias("n_lines"))
    return sessions.join(n, "session_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def dominant_languages(utts: DataFrame, min_votes: int = 4, minority: float = 0.05) -> DataFrame:
    """(session_id, speaker, lang): one ballot per decode; few ballots or a small minority take the meeting's language.

    utts: session_id, speaker, lang, text, decode (-1: a ballot of its own), seq (order). Ties go to the first seen.
    """
    said = utts.where((F.coalesce("lang", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    own = F.when(F.col("decode") == -1, F.concat(F.lit("r"), F.col("seq").cast("string"))).otherwise(F.col("decode").cast("string"))
    ballots = said.withColumn("_d", own).groupBy("session_id", "speaker", "lang", "_d").agg(F.min("seq").alias("seq"))
    per = ballots.groupBy("session_id", "speaker", "lang").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    total = per.groupBy("session_id", "lang").agg(F.sum("n").alias("all"), F.min("seq").alias("seq"))
    meeting = first_per(total, ["session_id"], F.desc("all"), "seq").select("session_id", F.col("lang").alias("_meeting"))
    cast = total.groupBy("session_id").agg(F.sum("all").alias("_ballots"))
    best = first_per(per.withColumn("_mine", F.sum("n").over(Window.partitionBy("session_id", "speaker"))), ["session_id", "speaker"], F.desc("n"), "seq")
    joined = utts.select("session_id", "speaker").distinct().join(best, ["session_id", "speaker"], "left").join(meeting, "session_id").join(cast, "session_id")
    shares = total.select("session_id", "lang", F.col("all").alias("_share"))
    joined = joined.join(shares, ["session_id", "lang"], "left")
    weak = (F.coalesce("_mine", F.lit(0)) < min_votes) | ((F.col("lang") != F.col("_meeting")) & (F.col("_share") < F.col("_ballots") * minority))
    return joined.select("session_id", "speaker", F.when(weak, F.col("_meeting")).otherwise(F.col("lang")).alias("lang"))


def boilerplate_rate(lines: DataFrame, flagged: Column) -> DataFrame:
    """(lang, weight, flagged, rate), the overall row with a null lang; a line weighs its normalised length, 1 at least."""
    w = F.greatest(F.lit(1), F.length(T.normalize(F.col("text"))))
    r = lines.select("lang", w.alias("_w"), F.when(flagged, w).otherwise(0).alias("_f")).rollup("lang").agg(F.sum("_w").alias("weight"), F.sum("_f").alias("flagged"))
    return r.withColumn("rate", F.round(F.col("flagged") / F.col("weight"), 4))


def talk_share(lines: DataFrame, least: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(speakers with chars, share and listed; languages with lines and main)."""
    per = lines.groupBy("session_id", "speaker").agg(F.sum(F.length("source")).alias("chars"))
    share = F.col("chars") / F.sum("chars").over(Window.partitionBy("session_id"))
    speakers = per.withColumn("share", F.round(share, 6)).withColumn("listed", share >= least)
    langs = lines.groupBy("session_id", "lang").agg(F.count("*").alias("n_lines"))
    w = Window.partitionBy("session_id").orderBy(F.desc("n_lines"), "lang")
    return speakers, langs.withColumn("main", F.row_number().over(w) == 1)


def ngram_vocabulary(lines: DataFrame, letters: str = T.HAN, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(gram, n): every overlapping string of the sizes inside runs of the letters."""
    run = lines.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"{letters}+"), F.lit(0))).alias("run"))
    grams = lambda k: F.when(F.length("run") >= k, F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring(F.col("run"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return run.select(F.explode(F.concat(*(grams(k) for k in sizes))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, junk_kept, clean_dropped) over lines with text; one pass, whatever the number of thresholds."""
    at = F.array(*(F.lit(float(t)) for t in thresholds))
    said = scored.where(F.trim("text") != "").groupBy("no_speech", "junk").agg(F.count("*").alias("_n"))
    each = said.withColumn("threshold", F.explode(at))
    keep = F.col("no_speech") < F.col("threshold")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return each.groupBy("threshold").agg(n(keep).alias("kept"), n(keep & F.col("junk")).alias("junk_kept"), n(~keep & ~F.col("junk")).alias("clean_dropped"))


def centroids(vectors: DataFrame, min_seconds: float = 20.0, least: float = 1.0) -> DataFrame:
    """(session_id, speaker, seconds, centroid): the mean vector of utterances of ``least`` seconds; quiet speakers drop out."""
    good = vectors.where(F.col("seconds") >= least)
    key = ["session_id", "speaker"]
    talk = good.groupBy(*key).agg(F.sum("seconds").alias("seconds")).where(F.col("seconds") >= min_seconds)
    cells = good.select(*key, F.posexplode("embedding").alias("_i", "_x")).groupBy(*key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    means = cells.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda c: c["_m"]).alias("centroid"))
    return talk.join(means, key)


def similarity_summary(pairs: DataFrame, threshold: float) -> DataFrame:
    """One row: pairs, those at the threshold, least, greatest, and the upper median.

    Pairs are counted by score before anything is dealt out. The median is then looked for in the range of scores that holds
    it: the ranges are a few thousand rows, the scores of one a part of all.
    """
    counted = cut_lineage(pairs.groupBy("score").agg(F.count("*").alias("n")))
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("score") >= threshold, F.col("n"))), F.lit(0)).alias("above"), F.min("score").alias("low"), F.max("score").alias("high"))
    scored = counted.where("score IS NOT NULL").withColumn("range", F.floor(F.col("score") * 1024))
    ranges = scored.groupBy("range").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(Window.orderBy(F.desc("range"))) - F.col("m"))
    half = F.broadcast(scored.agg(F.ceil(F.sum("n") / 2).alias("half")))
    holds = ranges.join(half).where((F.col("before") < F.col("half")) & (F.col("before") + F.col("m") >= F.col("half"))).select("range", "before", "half")
    inside = scored.join(F.broadcast(holds), "range").withColumn("upto", F.col("before") + F.sum("n").over(Window.orderBy(F.desc("score"))))
    return n.join(inside.where(F.col("upto") >= F.col("half")).agg(F.max("score").alias("median")))


def wording(text: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """array<struct<feature, n>> of one line: fillers, length bucket, Latin and digit marks."""
    length = F.length(T.squeeze(text))
    bucket = F.when(length < 12, "LEN:s").when(length < 30, "LEN:m").when(length < 60, "LEN:l").otherwise("LEN:x")
    one = lambda name, n: F.struct(name.alias("feature"), n.cast("long").alias("n"))
    count = lambda w: (F.length(text) - F.length(F.replace(text, F.lit(w)))) / len(w)
    every = [one(F.lit(f"F:{w}"), count(w)) for w in fillers] + [one(bucket, F.lit(1)), one(F.lit("EN:1"), text.rlike("[A-Za-z]{2,}").cast("int")), one(F.lit("NUM:1"), text.rlike("[0-9]").cast("int"))]
    return F.filter(F.array(*every), lambda x: x["n"] > 0)


def wording_profile(named: DataFrame, fillers: tuple[str, ...] = FILLERS) -> DataFrame:
    """(name, session_id, feature, n). named: name, session_id, text."""
    each = named.select("name", "session_id", F.explode(wording(F.coalesce("text", F.lit("")), fillers)).alias("f"))
    return each.groupBy("name", "session_id", F.col("f.feature").alias("feature")).agg(F.sum("f.n").alias("n"))


def rank_wording(profiles: DataFrame, tests: DataFrame, fillers: tuple[str, ...] = FILLERS) -> DataFrame:
    """(test_id, name, score, place): add-one naive Bayes of each test's lines under each name's profile.

    tests: test_id, session_id (the meeting left out of every profile, null for none), text. The vocabulary is that of
    the test and of all the profiles it is held against.
    """
    seen = tests.select("test_id", "session_id", F.explode(wording(F.coalesce("text", F.lit("")), fillers)).alias("f"))
    test = seen.groupBy("test_id", "session_id", F.col("f.feature").alias("feature")).agg(F.sum("f.n").alias("cnt"))
    all_ = profiles.groupBy("name", "feature").agg(F.sum("n").alias("n"))
    left_out = test.select("test_id", "session_id").distinct()
    # Profiles are names times a few dozen features.
    less = profiles.select("name", F.col("session_id").alias("_s"), "feature", F.col("n").alias("_less"))
    less = less.select("_s", F.col("name").alias("_name"), F.col("feature").alias("_feature"), "_less")
    held = left_out.join(small(all_)).join(less, (F.col("_s") == F.col("session_id")) & (F.col("_name") == F.col("name")) & (F.col("_feature") == F.col("feature")), "left")
    held = held.select("test_id", "name", "feature", (F.col("n") - F.coalesce("_less", F.lit(0))).alias("n")).where("n > 0")
    vocab = held.select("test_id", "feature").union(test.select("test_id", "feature")).distinct().groupBy("test_id").agg(F.count("*").alias("_v"))
    total = held.groupBy("test_id", "name").agg(F.sum("n").alias("_t")).join(vocab, "test_id")
    scored = total.join(test.select("test_id", "feature", "cnt"), "test_id").join(held, ["test_id", "name", "feature"], "left")
    score = F.sum(F.col("cnt") * F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("_t") + F.col("_v"))))
    out = scored.groupBy("test_id", "name").agg(score.alias("score"))
    w = Window.partitionBy("test_id").orderBy(F.desc(F.round("score", 9)), "name")
    return out.withColumn("place", F.row_number().over(w))


def speaker_conflicts(named: DataFrame, min_lines: int = 50, fillers: tuple[str, ...] = FILLERS) -> DataFrame:
    """(session_id, speaker, name, best, place): named codes of min_lines and more whose wording ranks another name first.

    named: session_id, speaker, name, text. The code's own meeting is left out of all profiles.
    """
    key = F.concat_ws(":", "session_id", "speaker")
    n = named.groupBy("session_id", "speaker", "name").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") >= min_lines).withColumn("test_id", key)
    tests = named.withColumn("test_id", key).join(n.select("test_id"), "test_id", "left_semi")
    ranks = rank_wording(wording_profile(named, fillers), tests.select("test_id", "session_id", "text"), fillers)
    many = Window.partitionBy("test_id")
    held = ranks.withColumn("_k", F.count("*").over(many)).withColumn("best", F.min_by("name", "place").over(many)).where("_k > 1")
    return n.join(held.select("test_id", "name", "best", "place"), ["test_id", "name"]).where("place > 1").orderBy(F.desc("place"), "test_id").select("session_id", "speaker", "name", "best", "place")


def fragment_codes(lines: DataFrame, max_lines: int = 3) -> DataFrame:
    """(session_id, speaker, n_lines): codes of few lines that never have a line of their own on either side."""
    w = Window.partitionBy("session_id").orderBy("start", "line_id")
    inside = (F.lag("speaker").over(w) == F.col("speaker")) | (F.lead("speaker").over(w) == F.col("speaker"))
    per = lines.withColumn("_in", F.coalesce(inside, F.lit(False))).groupBy("session_id", "speaker").agg(F.count("*").alias("n_lines"), F.bool_or("_in").alias("_in"))
    return per.where((F.col("n_lines") <= max_lines) & ~F.col("_in")).drop("_in")


def next_speaker_code(lines: DataFrame) -> DataFrame:
    n = F.coalesce(F.max(T.code_number(F.col("speaker"))), F.lit(0)) + 1
    return lines.groupBy("session_id").agg(F.concat(F.lit("S"), n.cast("string")).alias("code"))


def coverage(chunks: DataFrame) -> DataFrame:
    """(session_id, skipped): share of lines in skipped chunks, 0 where there are none."""
    part = F.sum(F.when(F.col("skipped"), F.col("n_lines")).otherwise(0)) / F.sum("n_lines")
    return chunks.groupBy("session_id").agg(F.coalesce(F.round(part, 6), F.lit(0.0)).alias("skipped"))


def regression_check(now: DataFrame, before: DataFrame) -> DataFrame:
    """(metric, was, value, worse): tracked numbers against the stored ones; a new metric is not worse."""
    b = before.select("metric", F.col("value").alias("was"))
    return now.join(b, "metric", "left").select("metric", "was", "value", F.coalesce(F.col("value") > F.col("was"), F.lit(False)).alias("worse"))


def speech_totals(utts: DataFrame) -> DataFrame:
    return utts.groupBy("session_id", "speaker").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end_time") - F.col("start")), 3).alias("seconds"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


def clip_cap(clips: DataFrame, n: int = 8) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("session_id"))
    return clips.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
