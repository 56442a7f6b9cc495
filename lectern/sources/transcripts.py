"""Transcripts, proposals, subtitles and stored tables in and out of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

LINE = r"^\[([0-9]+):([0-9]{2})\] (\S+) \(([^)]*)\) (.*)$"

#: What a stored table gets for columns that older files lack; end_time stays null on purpose.
DEFAULTS = {"status": "ok", "refined": False, "lines_rev": 0, "count": 1, "mode": "translate", "lang": ""}


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, row): the lines of whole files in their order."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("place", "row"))


def read_transcripts(spark: SparkSession, path: str, after_marker: bool = False, marker: str = r"^[-=]{3,}\s*$") -> DataFrame:
    """(file, place, start, speaker, lang, text) of rows ``[M:SS] S1 (lang) text``; other rows drop out.

    after_marker keeps what follows a file's last marker row: a tool that prints lines twice prints the final ones last.
    """
    rows = _rows(spark, path)
    if after_marker:
        last = rows.where(F.col("row").rlike(marker)).groupBy("file").agg(F.max("place").alias("_m"))
        rows = rows.join(last, "file", "left").where(F.col("place") > F.coalesce("_m", F.lit(-1))).drop("_m")
    part = lambda k: F.regexp_extract("row", LINE, k)
    good = rows.where(F.col("row").rlike(LINE))
    return good.select("file", "place", (part(1).cast("long") * 60 + part(2).cast("long")).cast("double").alias("start"), part(3).alias("speaker"), part(4).alias("lang"), part(5).alias("text"))


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, before, after): a row ``  [m:s] text`` directly followed by one that starts with ``->``."""
    w = Window.partitionBy("file").orderBy("place")
    rows = _rows(spark, path).withColumn("_next", F.lead("row").over(w))
    head, tail = r"^\s+\[[0-9]+:[0-9]+\]\s*(.*)$", r"^\s*->\s*(.*)$"
    return rows.where(F.col("row").rlike(head) & F.col("_next").rlike(tail)).select("file", "place", F.trim(F.regexp_extract("row", head, 1)).alias("before"), F.trim(F.regexp_extract("_next", tail, 1)).alias("after"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """(file, block, start, end_time, text) of subtitle files (file, value): blocks apart by blank lines, tags taken out."""
    blocks = files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("block", "_b"))
    time = r"(?:([0-9]+):)?([0-9]{1,2}):([0-9]{1,2})[.,]([0-9]{1,3})"
    both = rf"{time}\s*-->\s*{time}"
    part = lambda k: F.coalesce(F.regexp_extract("_b", both, k).try_cast("long"), F.lit(0))
    at = lambda k: (part(k) * 3600 + part(k + 1) * 60 + part(k + 2)).cast("double") + F.rpad(F.regexp_extract("_b", both, k + 3), 3, "0").try_cast("double") / 1000
    body = F.regexp_extract("_b", r"(?s)-->[^\n]*\n(.*)$", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), r"\s+", " "))
    return blocks.where(F.col("_b").rlike(both)).select("file", "block", at(1).alias("start"), at(5).alias("end_time"), text.alias("text")).where("text <> ''")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    return parse_vtt(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def pick_subtitle_track(tracks: DataFrame, languages: list[str]) -> DataFrame:
    """(media_id, track) of each medium's tracks (media_id, track, lang): the first configured language, else the first by name."""
    base = F.lower(F.split("lang", "-")[0])
    place = F.array_position(F.array(*(F.lit(x.split("-")[0].lower()) for x in languages)), base)
    w = Window.partitionBy("media_id").orderBy(F.when(place > 0, place).otherwise(1 << 30), "track")
    return tracks.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("media_id", "track")


def meeting_time(name: Column, modified: Column) -> Column:
    """The 14-digit stamp in a name; an impossible or missing one gives the file's time, then now."""
    pattern = r"([0-9]{4})[_.-]?([0-9]{2})[_.-]?([0-9]{2})[_.-]?([0-9]{2})[_.-]?([0-9]{2})[_.-]?([0-9]{2})"
    part = lambda k: F.regexp_extract(name, pattern, k).try_cast("int")
    return F.coalesce(F.try_make_timestamp(*(part(k) for k in range(1, 7))), modified, F.current_timestamp())


def subtitle_lines(cues: DataFrame, lang: str, corrected=lambda c: c) -> DataFrame:
    """Cues (session_id, block, start, end_time, text) as lines of S1, corrected, status ok. No cue at all is an error."""
    if cues.limit(1).count() == 0:
        raise ValueError("no cue")
    return cues.select("session_id", F.col("block").alias("line_id"), "start", "end_time", F.lit("S1").alias("speaker"), F.lit(lang).alias("lang"), corrected(F.col("text")).alias("source"), F.lit("ok").alias("status"), F.lit(False).alias("refined"))


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables, with columns that older files lack filled by their defaults."""
    out = {}
    for name, schema in schemas.items():
        empty = spark.createDataFrame([], schema)
        df = empty.unionByName(spark.read.option("mergeSchema", True).parquet(f"{path}/{name}"), allowMissingColumns=True)
        out[name] = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in empty.columns}).select(*empty.columns)
    return out


def portable_path(path: Column, root: str) -> Column:
    """A path under the root stored relative; an absolute one with a recordings part from there on; others as they are."""
    at = F.instr(path, "/recordings/")
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, F.length(path))).when(path.startswith("/") & (at > 0), F.substring(path, at + 1, F.length(path))).otherwise(path)


def recent_corpus(lines: DataFrame, limit: int = 20_000) -> DataFrame:
    """The newest lines by id; kept as rows."""
    return lines.orderBy(F.desc("line_id")).limit(limit).select("line_id", "source")


def to_vtt(lines: DataFrame, names: DataFrame, lang: str | None = None) -> DataFrame:
    """(session_id, value): one subtitle track per meeting, of the source or of one language's translations."""
    text = F.col("source") if lang is None else F.try_element_at("translations", F.lit(lang))
    said = lines.withColumn("_t", text).where(F.trim(F.coalesce("_t", F.lit(""))) != "")
    said = said.join(names.select("session_id", F.col("code").alias("speaker"), F.col("name").alias("_n")), ["session_id", "speaker"], "left")
    w = Window.partitionBy("session_id").orderBy("start", "line_id")
    end = F.coalesce("end_time", F.col("start") + 2)
    cut = F.greatest(F.least(end, F.coalesce(F.lead("start").over(w), end)), F.col("start") + 0.1)
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cue = F.concat(T.vtt_time(F.col("start")), F.lit(" --> "), T.vtt_time(F.col("_e")), F.lit("\n"), escape(F.coalesce("_n", "speaker")), F.lit(": "), escape(F.trim("_t")))
    return said.withColumn("_e", cut).groupBy("session_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "line_id", cue.alias("c")))), lambda x: x["c"]), "\n\n"), F.lit("\n")).alias("value"))


def to_markdown(lines: DataFrame, names: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(session_id, value): speakers in the order of their codes, unnamed ones flagged, each line with its translations, and
    the summary with a warning if it is stale (summaries: session_id, summary, status, stale)."""
    who = lines.select("session_id", "speaker").distinct().join(names.select("session_id", F.col("code").alias("speaker"), "name"), ["session_id", "speaker"], "left")
    n = F.coalesce(T.code_number(F.col("speaker")), F.lit(1 << 30))
    entry = F.concat(F.lit("- "), "speaker", F.lit(": "), F.coalesce("name", F.lit("(unnamed)")))
    people = who.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(n.alias("n"), "speaker", entry.alias("e")))), lambda x: x["e"]), "\n").alias("_people"))
    named = lines.join(names.select("session_id", F.col("code").alias("speaker"), F.col("name").alias("_n")), ["session_id", "speaker"], "left")
    other = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("translations", F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit("\n  - "), e["key"], F.lit(": "), e["value"])), "")
    row = F.concat(F.lit("["), T.minute_second(F.col("start")), F.lit("] **"), F.coalesce("_n", "speaker"), F.lit("** "), "source", other)
    body = named.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "line_id", row.alias("r")))), lambda x: x["r"]), "\n").alias("_body"))
    out = people.join(body, "session_id").withColumn("_top", F.lit(""))
    if summaries is not None:
        s = summaries.where("status <> 'failed'").select("session_id", F.concat(F.lit("## Summary\n"), F.when(F.col("stale"), "> The transcript has changed since.\n").otherwise(""), "summary", F.lit("\n\n")).alias("_s"))
        out = out.join(s, "session_id", "left").withColumn("_top", F.coalesce("_s", F.lit("")))
    return out.select("session_id", F.concat("_top", F.lit("## Speakers\n"), "_people", F.lit("\n\n## Lines\n"), "_body", F.lit("\n")).alias("value"))


def turn_document(lines: DataFrame) -> DataFrame:
    """(session_id, value): turns with clock and speaker, the language marked where it is not the main one, and shares on top."""
    from ..operators import aggs, windows

    speakers, langs = aggs.talk_share(lines)
    head = speakers.where("listed").groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("share", "speaker")), asc=False), lambda x: F.concat(x["speaker"], F.lit(" "), F.format_number(x["share"] * 100, 0), F.lit("%"))), ", ").alias("_head"))
    main = langs.where("main").select("session_id", F.col("lang").alias("_main"))
    t = windows.turns(lines).join(main, "session_id")
    row = F.concat(F.lit("**"), "speaker", F.lit("** "), T.clock(F.col("start")), F.when(F.col("lang") != F.col("_main"), F.concat(F.lit(" ("), "lang", F.lit(")"))).otherwise(""), F.lit("\n"), "text")
    body = t.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"]), "\n\n").alias("_body"))
    return head.join(body, "session_id").select("session_id", F.concat("_head", F.lit("\n\n"), "_body", F.lit("\n")).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One file per meeting of (session_id, value)."""
    documents.repartition("session_id").write.partitionBy("session_id").option("lineSep", "\n").mode("overwrite").text(path)


def write_transcripts(lines: DataFrame, path: str) -> None:
    """One file per meeting, in the format that read_transcripts reads; line ends inside a text become blanks."""
    row = F.concat(F.lit("["), T.minute_second(F.col("start")), F.lit("] "), "speaker", F.lit(" ("), "lang", F.lit(") "), F.regexp_replace("source", r"[\r\n]+", " "))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "line_id", row.alias("r")))), lambda x: x["r"]), "\n")
    write_documents(lines.groupBy("session_id").agg(whole.alias("value")), path)
