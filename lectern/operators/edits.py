"""Edits as a log: lines, transcripts, names, terms, and what goes with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins
from .common import first_per


def apply_line_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines after the edits (line_id, n, kind, text) in the order of n.

    hand: keeps the first text in orig_source and sets refined. rerun: other words clear orig_source, the same leave it.
    model: new text and refined, no trace.
    """
    log = edits.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("n", "kind", "text"))).alias("_log"))
    base = lines if "orig_source" in lines.columns else lines.withColumn("orig_source", F.lit(None).cast("string"))
    state = F.struct(F.col("source").alias("source"), F.col("orig_source").alias("orig"), F.col("refined").alias("refined"))

    def step(a, e):
        hand, rerun = e["kind"] == "hand", e["kind"] == "rerun"
        orig = F.when(hand, F.coalesce(a["orig"], a["source"])).when(rerun & (a["source"] != e["text"]), F.lit(None).cast("string")).otherwise(a["orig"])
        return F.struct(e["text"].alias("source"), orig.alias("orig"), F.when(rerun, a["refined"]).otherwise(F.lit(True)).alias("refined"))

    done = base.join(log, "line_id", "left").withColumn("_s", F.when(F.col("_log").isNull(), state).otherwise(F.aggregate("_log", state, step)))
    own = [F.col(f"_s.{ {'source': 'source', 'orig_source': 'orig', 'refined': 'refined'}[c]}").alias(c) if c in ("source", "orig_source", "refined") else F.col(c) for c in base.columns]
    return done.select(*own)


def revisions(edits: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, lines_rev): each edit to words or speakers adds one."""
    n = edits.groupBy("session_id").agg(F.count("*").alias("_n"))
    return sessions.join(n, "session_id", "left").select("session_id", (F.col("lines_rev") + F.coalesce("_n", F.lit(0))).cast("long").alias("lines_rev"))


def stale_summaries(summaries: DataFrame, sessions: DataFrame) -> DataFrame:
    """summaries with ``stale``: was the transcript edited since."""
    return summaries.join(sessions.select("session_id", F.col("lines_rev").alias("_now")), "session_id").withColumn("stale", F.col("lines_rev") != F.col("_now")).drop("_now")


def replace_transcript(old: DataFrame, new: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines after, prints after): new lines take the place of their meetings' old ones; hand edits are carried over by
    time, and prints whose code labels no line go. A meeting without new lines stays as it is."""
    swapped = new.select("session_id").distinct()
    hand = old.where("orig_source IS NOT NULL").join(swapped, "session_id", "left_semi")
    edits = hand.select(F.col("line_id").alias("edit_id"), "session_id", "start", "end_time")
    carried = joins.restore_edits(edits, new).join(hand.select(F.col("line_id").alias("edit_id"), F.col("source").alias("_hand")), "edit_id").select("line_id", "_hand")
    fresh = new.join(carried, "line_id", "left")
    fresh = fresh.withColumn("orig_source", F.when(F.col("_hand").isNotNull(), F.col("source")).otherwise(F.lit(None).cast("string"))).withColumn("source", F.coalesce("_hand", "source")).withColumn("refined", F.col("refined") | F.col("_hand").isNotNull()).drop("_hand")
    after = old.join(swapped, "session_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
    touched = prints.join(swapped, "session_id", "left_semi")
    return after, prints.join(swapped, "session_id", "left_anti").unionByName(joins.stale_prints(touched, after))


def merge_speakers(lines: DataFrame, names: DataFrame, prints: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, names, prints) after codes are absorbed. mapping: session_id, code, into."""
    m = mapping.where("code <> into").select("session_id", "code", "into")
    relabelled = lines.join(m.withColumnRenamed("code", "speaker"), ["session_id", "speaker"], "left").withColumn("speaker", F.coalesce("into", "speaker")).drop("into")
    return relabelled, names.join(m, ["session_id", "code"], "left_anti"), prints.join(m, ["session_id", "code"], "left_anti")


def rename_speaker(table: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with names changed, refused renames). renames: old, new; refused if new exists or old does not."""
    there = table.select("name").distinct()
    good = renames.join(there.withColumnRenamed("name", "new"), "new", "left_anti").join(there.withColumnRenamed("name", "old"), "old", "left_semi")
    changed = table.join(good.select(F.col("old").alias("name"), F.col("new").alias("_new")), "name", "left").withColumn("name", F.coalesce("_new", "name")).drop("_new")
    return changed, renames.join(good, ["old", "new"], "left_anti")


def forget(name: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without the name; the names that meetings gave stay out of this."""
    return tuple(t.where(F.col("name") != name) for t in tables)


def delete_sessions(gone: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without the meetings (session_id) that go."""
    return tuple(t.join(gone.select("session_id").distinct(), "session_id", "left_anti") for t in tables)


def upsert_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Terms after the additions (seq, source, lang, mode): unique by (source, lang), the newest wins; bad ones refused."""
    good = new.where((F.trim("source") != "") & F.col("mode").isin("translate", "keep", "hint", "protect"))
    both = terms.select(F.lit(-1).cast("long").alias("seq"), "source", "lang", "mode").unionByName(good.select(F.col("seq").cast("long").alias("seq"), F.trim("source").alias("source"), "lang", "mode"))
    return first_per(both, ["source", "lang"], F.desc("seq"), "mode").drop("seq")


def upsert_latest(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table after the changes (its columns and seq): the newest value per key."""
    both = table.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes.withColumn("seq", F.col("seq").cast("long")))
    return first_per(both, keys, F.desc("seq")).drop("seq")


def accept_candidates(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """Terms with the candidates (source, lang) not yet known added as hints."""
    new = candidates.select("source", "lang").distinct().join(terms.select("source").distinct(), "source", "left_anti")
    return upsert_terms(terms, new.select(F.lit(0).cast("long").alias("seq"), "source", "lang", F.lit("hint").alias("mode")))


def clip_undo(clips: DataFrame, prints: DataFrame, names: DataFrame, session_prints: DataFrame, undo: DataFrame, to: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clips, prints, names) after the samples (name, session_id) turn out wrong: the meeting's prints are unlearned and
    its naming goes, or moves to another name. A name whose last sample went is forgotten."""
    from .voices import unlearn_voice

    key = ["name", "session_id"]
    left = clips.join(undo, key, "left_anti")
    named = names.join(undo, key, "left_semi")
    wrong = named.join(session_prints.select("session_id", "code", F.col("centroid").alias("vector")), ["session_id", "code"]).select("name", "vector")
    kept = unlearn_voice(prints, wrong)
    other = names.join(undo, key, "left_anti")
    if to is not None:
        other = other.unionByName(named.withColumn("name", F.lit(to)))
        left = left.unionByName(undo.select(F.lit(to).alias("name"), "session_id")).distinct()
    live = left.select("name").union(other.select("name")).distinct()
    lost = undo.select("name").distinct().join(live, "name", "left_anti")
    return left, kept.join(lost, "name", "left_anti"), other
