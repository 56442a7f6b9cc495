"""Rankings, limits and unions of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def hits_per_session(hits: DataFrame) -> DataFrame:
    return hits.groupBy("session_id").agg(F.count("*").alias("hits"))


def pick_sessions(hits: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """(session_id, hits): by hits, then place in the index (newest first); free slots from the index in order."""
    # The place in the index is the order of (started, session_id), so nothing needs to be numbered.
    placed = index.select("session_id", "started", F.lit(True).alias("_in"))
    every = hits.join(placed, "session_id", "left").select("session_id", "hits", "_in", "started").union(placed.join(hits, "session_id", "left_anti").select("session_id", F.lit(0).cast("long"), "_in", "started"))
    return every.orderBy(F.desc("hits"), F.desc_nulls_last("_in"), F.desc_nulls_last("started"), F.desc("session_id")).limit(limit).select("session_id", "hits")


def summary_index(sessions: DataFrame, summaries: DataFrame, n: int = 60, lang: str = "en") -> DataFrame:
    """The newest meetings with title and decisions of their summary; a failed or broken one gives blanks."""
    body = F.get_json_object("json", f"$.{lang}")
    good = F.col("status") == "ok"
    s = summaries.select("session_id", F.when(good, F.get_json_object(body, "$.title")).alias("title"), F.when(good, F.get_json_object(body, "$.decisions")).alias("decisions"))
    found = sessions.orderBy(F.desc("started"), F.desc("session_id")).limit(n).join(s, "session_id", "left")
    return found.select("session_id", "started", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("decisions", F.lit("")).alias("decisions"))


def top_changes(changes: DataFrame, k: int = 10) -> DataFrame:
    """(class, was, now, n): the k most frequent changes of each class."""
    counted = changes.groupBy("class", "was", "now").agg(F.count("*").alias("n"))
    w = Window.partitionBy("class").orderBy(F.desc("n"), "was", "now")
    return counted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def order_corrections(corrections: DataFrame) -> DataFrame:
    return corrections.orderBy(F.desc(F.length("wrong")), "wrong")


def speaker_code_order(codes: DataFrame) -> DataFrame:
    """S-codes by number, others after them."""
    n = T.code_number(F.col("speaker"))
    return codes.orderBy(n.isNull(), n, "speaker")


def screen_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each meeting."""
    w = Window.partitionBy("session_id").orderBy(F.desc("start"), F.desc("line_id"))
    return lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def with_index_picks(hits: DataFrame, picks: DataFrame, enough: int = 2) -> DataFrame:
    """Hits, and where there are under ``enough`` of them the picked meetings with no hits."""
    n = hits.agg(F.count("*").alias("_n"))
    extra = picks.select("session_id").distinct().join(hits, "session_id", "left_anti").join(F.broadcast(n)).where(F.col("_n") < enough)
    return hits.select("session_id", "hits").union(extra.select("session_id", F.lit(0).cast("long")))
