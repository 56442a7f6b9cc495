"""Windows, islands and ordered folds over lines, turns and utterances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import first_per

#: Marks that end a sentence (fixed values).
TERMINAL = "。．.！!？?…"


def _in_order(*extra: str):
    return Window.partitionBy("session_id", *extra).orderBy("start", "line_id")


def turns(lines: DataFrame, pause: float = 20.0) -> DataFrame:
    """(session_id, turn, speaker, lang, start, text, n_lines): consecutive lines of one speaker and language.

    A line joins while it starts within the pause of the start before it. Texts join with a blank, but not before an
    opening comma or full stop.
    """
    w = _in_order()
    same = (F.lag("speaker").over(w) == F.col("speaker")) & (F.lag("lang").over(w) == F.col("lang")) & (F.col("start") - F.lag("start").over(w) <= pause)
    marked = lines.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("turn", F.sum("_new").over(w))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start", "line_id", "source"))), lambda x: x["source"])
    glued = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.get(parts, F.lit(0)), lambda a, t: F.when(t.rlike("^[，。、,.]"), F.concat(a, t)).otherwise(F.concat_ws(" ", a, t)))
    return marked.groupBy("session_id", "turn").agg(F.first("speaker").alias("speaker"), F.first("lang").alias("lang"), F.min("start").alias("start"), glued.alias("text"), F.count("*").alias("n_lines"))


def heal_turns(turns_: DataFrame, gap: float = 0.5) -> DataFrame:
    """(session_id, speaker, start, end_time): neighbouring turns of one speaker with less than the gap between are one."""
    w = Window.partitionBy("session_id").orderBy("start", "turn_id")
    block = turns_.withColumn("_b", F.sum((~F.coalesce(F.lag("speaker").over(w) == F.col("speaker"), F.lit(False))).cast("int")).over(w))
    inner = Window.partitionBy("session_id", "_b").orderBy("start", "turn_id")
    before = F.max("end_time").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    cut = block.withColumn("_c", (before.isNull() | (F.col("start") - before >= gap)).cast("int")).withColumn("_i", F.sum("_c").over(inner))
    return cut.groupBy("session_id", "_b", "_i").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end_time").alias("end_time")).drop("_b", "_i")


def inherit(df: DataFrame, value: Column, by: list[str], order: list[str]) -> DataFrame:
    """df with ``filled``: value, where null the one before, where there is none the next.

    The next one of a row with none before it is the first of all, so its window is the whole one, read once; a window from
    each row to the end would be read anew for each row.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    back = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("_v", value).withColumn("filled", F.coalesce(back, ahead)).drop("_v")


def inherit_speaker(utts: DataFrame) -> DataFrame:
    """Blank speakers take the one before, leading ones the next."""
    return inherit(utts, F.when(F.coalesce("speaker", F.lit("")) != "", F.col("speaker")), ["session_id"], ["start", "line_id"]).withColumn("speaker", F.coalesce("filled", "speaker")).drop("filled")


def absorb_strays(turns_: DataFrame, least: float = 5.0) -> DataFrame:
    """Labels that speak under ``least`` seconds in all take a neighbour's label; nothing changes if all do."""
    total = F.sum(F.col("end_time") - F.col("start")).over(Window.partitionBy("session_id", "speaker"))
    kept = inherit(turns_.withColumn("_t", total), F.when(F.col("_t") >= least, F.col("speaker")), ["session_id"], ["start", "turn_id"])
    return kept.withColumn("speaker", F.coalesce("filled", "speaker")).drop("filled", "_t")


def inherit_short(utts: DataFrame, least: float = 1.0) -> DataFrame:
    """Utterances under ``least`` seconds take the label before; with nothing long all are S1."""
    long_ = F.when(F.col("end_time") - F.col("start") >= least, F.col("speaker"))
    return inherit(utts, long_, ["session_id"], ["start", "line_id"]).withColumn("speaker", F.coalesce("filled", F.lit("S1"))).drop("filled")


def boundary_flags(lines: DataFrame) -> DataFrame:
    """Lines with ``other_before`` and ``other_after``: is the neighbour another speaker."""
    w = _in_order()
    differs = lambda c: F.coalesce(c != F.col("speaker"), F.lit(False))
    return lines.withColumn("other_before", differs(F.lag("speaker").over(w))).withColumn("other_after", differs(F.lead("speaker").over(w)))


def speaker_samples(lines: DataFrame, least: float = 3.0, ideal: float = 8.0, trim: float = 0.6) -> DataFrame:
    """(session_id, speaker, line_id, start, end_time, text): the line that shows a voice best, cut where others are near.

    Lines of ``least`` seconds first, then those between lines of the same speaker, then the nearest to the ideal
    length, then the longest text. An edge next to another speaker is cut by trim or a quarter of what is left.
    """
    marked = boundary_flags(lines.where(F.col("end_time").isNotNull()))
    span = F.col("end_time") - F.col("start")
    best = first_per(
        marked.withColumn("_span", span),
        ["session_id", "speaker"],
        F.desc(F.col("_span") >= least),
        F.col("other_before").cast("int") + F.col("other_after").cast("int"),
        F.abs(F.col("_span") - ideal),
        F.desc(F.length("source")),
        "line_id",
    )
    head = F.when(F.col("other_before"), F.least(F.lit(trim), F.col("_span") / 4)).otherwise(0.0)
    cut = best.withColumn("_head", head)
    left = F.col("_span") - F.col("_head")
    tail = F.when(F.col("other_after"), F.least(F.lit(trim), left / 4)).otherwise(0.0)
    return cut.select("session_id", "speaker", "line_id", (F.col("start") + F.col("_head")).alias("start"), (F.col("end_time") - tail).alias("end_time"), F.col("source").alias("text"))


def voiceprint_samples(utts: DataFrame, n: int = 5, least: float = 1.0, ideal: float = 8.0) -> DataFrame:
    """The n utterances per speaker to learn a voice from: not beside another speaker first, then nearest the ideal."""
    marked = boundary_flags(utts).withColumn("_span", F.col("end_time") - F.col("start")).where(F.col("_span") >= least)
    w = Window.partitionBy("session_id", "speaker").orderBy(F.col("other_before") | F.col("other_after"), F.abs(F.col("_span") - ideal), "start", "line_id")
    return marked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_span")


def context_lines(lines: DataFrame, n: int = 3) -> DataFrame:
    """Lines with ``context``: the texts of the n lines before, in order."""
    return lines.withColumn("context", F.collect_list("source").over(_in_order().rowsBetween(-n, -1)))


def chunks(lines: DataFrame, size: int = 25) -> DataFrame:
    return lines.withColumn("place", F.row_number().over(_in_order()) - 1).withColumn("chunk", F.floor(F.col("place") / size)).withColumn("place", F.col("place") % size + 1)


def even_sample(lines: DataFrame, budget: Column, by: list[str] | None = None) -> DataFrame:
    """Lines evenly thinned to a budget of characters, per speaker; as they are where they fit.

    Each speaker keeps max(1, count times ratio, half-even) lines at even places; if that is still too much, a second
    even pass runs over all of them.
    """
    by = by or ["session_id"]
    order = ["start", "line_id"]
    whole = Window.partitionBy(*by)

    def pass_(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        sized = df.withColumn("_total", F.sum(F.length("source")).over(whole)).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
        take = F.greatest(F.lit(1), F.bround(F.col("_n") * F.col("_budget") / F.col("_total")).cast("int"))
        # Place i is taken if some k has floor(k * count / take) = i.
        k = F.ceil(F.col("_i") * F.col("_take") / F.col("_n"))
        hit = (k < F.col("_take")) & (F.floor(k * F.col("_n") / F.col("_take")) == F.col("_i"))
        return sized.withColumn("_take", take).where((F.col("_total") <= F.col("_budget")) | hit).drop("_total", "_i", "_n", "_take")

    first = pass_(lines.withColumn("_budget", budget), [*by, "speaker"])
    return pass_(first, by).drop("_budget")


def fit_sessions(lines: DataFrame, budget: int) -> DataFrame:
    """Lines of all meetings thinned to one budget, shared equally; ``cut`` says whether the meeting lost lines."""
    n = lines.select("session_id").distinct().agg(F.count("*").alias("_m"))
    shared = lines.join(F.broadcast(n)).withColumn("_share", F.floor(F.lit(budget) / F.col("_m"))).drop("_m")
    had = shared.withColumn("_had", F.count("*").over(Window.partitionBy("session_id")))
    kept = even_sample(had, F.col("_share"))
    return kept.withColumn("cut", F.count("*").over(Window.partitionBy("session_id")) < F.col("_had")).drop("_had", "_share")


def chunk_spans(meetings: DataFrame, chunk: float = 180.0, overlap: float = 20.0) -> DataFrame:
    """(session_id, chunk, core_start, core_end, read_start, read_end): cores tile the length, reads are padded."""
    if overlap < 10:
        raise ValueError("an overlap under 10 s cuts words")
    n = F.greatest(F.lit(1), F.ceil(F.col("seconds") / chunk))
    c = meetings.select("session_id", "seconds", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    a, b = F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("seconds"))
    return c.select("session_id", "chunk", a.cast("double").alias("core_start"), b.cast("double").alias("core_end"), F.greatest(a - overlap, F.lit(0.0)).alias("read_start"), F.least(b + overlap, F.col("seconds")).alias("read_end"))


# ---- folds: whether a row joins depends on where its run began ----


def _fold(df: DataFrame, fields: list[str], follows: Callable[[Column], Column], seconds: float, chars: int | None = None) -> DataFrame:
    """df with ``run``: rows of a session in order, each joining the run before if it follows the row before and the run
    then still is within seconds (from its first start to the row's end) and chars.

    Whether a row follows is an expression over the row before. Only the bounds need the run's beginning; they are a single
    pass over four numbers a row, linear in the meeting's length.
    """
    before = F.lag(F.struct("start", *fields)).over(Window.partitionBy("session_id").orderBy("start", "line_id"))
    size = F.length("source") if chars is not None else F.lit(0)
    plain = df.withColumn("_p", before).select("session_id", "line_id", "start", F.col("end_time").cast("double").alias("end_time"), size.cast("double").alias("size"), F.coalesce(follows(F.col("_p")), F.lit(False)).alias("follows"))
    types = dict(df.dtypes)

    def number(t: pa.Table) -> pa.Table:
        t = t.sort_by([("start", "ascending"), ("line_id", "ascending")])
        run, first, held, out = 0, 0.0, 0.0, []
        # A missing number is never within a bound.
        cols = (np.array([float("nan") if v is None else v for v in t[c].to_pylist()], float).tolist() for c in ("start", "end_time", "size"))
        for start, end, n, more in zip(*cols, t["follows"].to_pylist(), strict=True):
            if more and end - first <= seconds and (chars is None or held + n <= chars):
                held += n
            else:
                run, first, held = run + 1, start, n
            out.append(run)
        return t.select(["session_id", "line_id"]).append_column("run", pa.array(out, pa.int32()))

    runs = plain.groupBy("session_id").applyInArrow(number, f"session_id {types['session_id']}, line_id {types['line_id']}, run int")
    return df.join(runs, ["session_id", "line_id"])


def merge_runs(utts: DataFrame, max_gap: float = 2.0, max_span: float = 20.0) -> DataFrame:
    """Utterances with ``run``: one speaker, gaps of 0 to max_gap, at most max_span from first start to last end."""

    def follows(p: Column) -> Column:
        gap = F.col("start") - p["end_time"]
        return (p["speaker"] == F.col("speaker")) & (gap >= 0) & (gap <= max_gap)

    return _fold(utts, ["end_time", "speaker"], follows, max_span)


def _runs(lines: DataFrame, blocked: DataFrame | None, seconds: float, chars: int, terminal: bool, max_gap: float) -> DataFrame:
    marked = lines.withColumn("_blocked", F.lit(False))
    if blocked is not None:
        marked = lines.join(blocked.select("session_id", "line_id").distinct().withColumn("_hit", F.lit(True)), ["session_id", "line_id"], "left").withColumn("_blocked", F.coalesce("_hit", F.lit(False))).drop("_hit")

    def follows(p: Column) -> Column:
        x = F.col
        ok = (p["speaker"] == x("speaker")) & (p["lang"] == x("lang")) & (p["status"] == "ok") & (x("status") == "ok") & ~p["refined"] & ~x("refined")
        ok = ok & p["end_time"].isNotNull() & x("end_time").isNotNull() & (x("start") - p["end_time"] <= max_gap) & ~x("_blocked")
        if terminal:
            text = F.rtrim(p["source"])
            ok = ok & (text != "") & ~F.lit(TERMINAL).contains(F.right(text, F.lit(1)))
        return ok

    runs = _fold(marked, ["end_time", "speaker", "lang", "status", "refined", "source"], follows, seconds, chars)
    n = F.count("*").over(Window.partitionBy("session_id", "run"))
    return runs.withColumn("_n", n).where("_n > 1").drop("_n", "_blocked")


def merge_fragments(lines: DataFrame, blocked: DataFrame | None = None, max_gap: float = 1.0, seconds: float = 30.0, chars: int = 120) -> DataFrame:
    """Lines with ``run`` that are pieces of one sentence; only runs of two and more. blocked: lines (session_id,
    line_id) before which somebody else spoke."""
    return _runs(lines, blocked, seconds, chars, True, max_gap)


def candidate_runs(lines: DataFrame, blocked: DataFrame | None = None, max_gap: float = 1.0, seconds: float = 60.0, chars: int = 240) -> DataFrame:
    """Lines with ``run`` that could be one sentence; whether they are is a question about the words."""
    return _runs(lines, blocked, seconds, chars, False, max_gap)


def join_lines(runs: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """One row per run: first line's id and start, last end, texts joined (Chinese with nothing, others with a blank)."""
    parts = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("start", "line_id", "source"))), lambda x: F.trim(x["source"])), lambda t: t != "")
    one = runs.groupBy("session_id", "run").agg(
        F.min_by("line_id", F.struct("start", "line_id")).alias("line_id"), F.min("start").alias("start"), F.max_by("end_time", F.struct("start", "line_id")).alias("end_time"), F.first("speaker").alias("speaker"), F.first("lang").alias("lang"), parts.alias("_p")
    )
    out = one.withColumn("source", F.when(F.col("lang").startswith("zh"), F.array_join("_p", "")).otherwise(F.array_join("_p", " "))).drop("_p")
    if translations is None:
        return out
    t = runs.select("session_id", "run", "line_id", "start").join(translations.select("line_id", F.col("lang").alias("_l"), "text"), "line_id").where(F.trim("text") != "")
    per = t.groupBy("session_id", "run", "_l").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "line_id", "text"))), lambda x: F.trim(x["text"])), " ").alias("_t"))
    folded = per.groupBy("session_id", "run").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_l", "_t")))).alias("translations"))
    return out.join(folded, ["session_id", "run"], "left")
