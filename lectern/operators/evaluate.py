"""Evaluation against a reference transcript, and the cutting of utterances on turns."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import correction as C
from ..functions import text as T
from .common import in_cells
from .joins import nearest_line


def error_rate(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(session_id, lang, metric, errors, total, rate): characters where the reference is mostly Han, else words.

    Each side's texts are gathered by its own language, in order. A meeting's text of one language is one group.
    """

    def whole(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("session_id", "lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "line_id", "source"))), lambda x: x["source"]).alias(name))

    both = whole(ref, "_r").join(whole(hyp, "_h"), ["session_id", "lang"], "left")
    flat = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    han = T.mostly_han(flat("_r"))
    sides = both.select("session_id", "lang", F.when(han, "cer").otherwise("wer").alias("metric"), F.when(han, T.normalize(flat("_r"))).otherwise(F.lower(flat("_r"))).alias("r"), F.when(han, T.normalize(flat("_h"))).otherwise(F.lower(flat("_h"))).alias("h"))

    @F.pandas_udf("struct<errors:long,total:long>")
    def count(metric: pd.Series, r: pd.Series, h: pd.Series) -> pd.DataFrame:
        units = [(list(a), list(b)) if m == "cer" else (a.split(), b.split()) for m, a, b in zip(metric, r, h, strict=True)]
        return pd.DataFrame({"errors": [C.distance(a, b) if a else 0 for a, b in units], "total": [len(a) for a, _ in units]})

    out = sides.withColumn("_c", count("metric", "r", "h"))
    rate = F.when(F.col("_c.total") > 0, F.round(F.col("_c.errors") / F.col("_c.total"), 4)).otherwise(0.0)
    return out.select("session_id", "lang", "metric", F.col("_c.errors").alias("errors"), F.col("_c.total").alias("total"), rate.alias("rate"))


def speaker_error(ref: DataFrame, hyp: DataFrame, most: int = 7) -> DataFrame:
    """(session_id, error, ref_speakers, hyp_speakers, note): attribution error under the best one-to-one map of labels.

    Lines pair by time; one without a pair is a label of its own. A line weighs its normalised length. More than
    ``most`` labels on the side judged are not mapped; the reference may have any number.
    """
    near = nearest_line(ref, hyp)
    h = hyp.select(F.col("line_id").alias("hyp_id"), F.col("speaker").alias("h"))
    weight = F.greatest(F.lit(1), F.length(T.normalize(F.col("source"))))
    pairs = ref.select("session_id", F.col("line_id").alias("ref_id"), F.col("speaker").alias("r"), weight.alias("w")).join(near, ["session_id", "ref_id"], "left").join(h, "hyp_id", "left")
    matrix = pairs.groupBy("session_id", "r", F.coalesce("h", F.lit("∅")).alias("h")).agg(F.sum("w").alias("w"))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        left, right = sorted(set(group["r"])), sorted(set(group["h"]))
        total = int(group["w"].sum())
        error, note = None, f"{len(right)} labels are too many to map"
        if len(right) <= most:
            cell = {(r, h): w for r, h, w in zip(group["r"], group["h"], group["w"], strict=True)}
            # A label may also stay without a partner, which places of no weight stand for.
            hit = best_assignment([[int(cell.get((r, h), 0)) for h in right] for r in left])
            error, note = round(1 - hit / total, 4) if total else 0.0, ""
        return pd.DataFrame([(group["session_id"].iloc[0], error, len(left), len(right), note)], columns=["session_id", "error", "ref_speakers", "hyp_speakers", "note"])

    return matrix.groupBy("session_id").applyInPandas(best, "session_id long, error double, ref_speakers int, hyp_speakers int, note string")


def best_assignment(weight: list[list[int]]) -> int:
    """The largest sum of weights over one-to-one maps of rows to columns, by shortest augmenting paths with prices.

    Each row in turn looks for a column; where it is held, the holder moves on along the path that costs least. Prices of
    rows and columns keep every step's cost at zero or above, so a path is found by taking the nearest column each time.
    """
    if len(weight) > len(weight[0]):
        weight = [list(column) for column in zip(*weight, strict=True)]
    rows, cols = len(weight), len(weight[0])
    row_price, col_price, holder = [0] * rows, [0] * (cols + 1), [-1] * (cols + 1)
    for new in range(rows):
        # The place past the columns is where the path of the new row starts.
        holder[cols], at = new, cols
        near, came, seen = [float("inf")] * cols, [cols] * cols, set()
        while holder[at] >= 0:
            seen.add(at)
            r = holder[at]
            for c in range(cols):
                if c not in seen:
                    cost = -weight[r][c] - row_price[r] - col_price[c]
                    if cost < near[c]:
                        near[c], came[c] = cost, at
            to = min((c for c in range(cols) if c not in seen), key=near.__getitem__)
            step = near[to]
            for c in seen:
                row_price[holder[c]] += step
                col_price[c] -= step
            near = [v if c in seen else v - step for c, v in enumerate(near)]
            at = to
        while at != cols:
            holder[at], at = holder[came[at]], came[at]
    return sum(weight[holder[c]][c] for c in range(cols) if holder[c] >= 0)


def split_on_turns(utts: DataFrame, turns: DataFrame, least: float = 0.5) -> DataFrame:
    """(session_id, line_id, piece, start, end_time, speaker): utterances cut on every turn edge inside them.

    A piece goes to the turn with the most overlap (ties: the latest start), one without a turn to the voice around it
    (-1 if there is none); equal neighbours join, and pieces under ``least`` seconds, shortest first, go into the longer
    neighbour (ties: the earlier).
    """
    rows = utts.select("session_id", F.col("line_id").alias("id"), F.lit(0).alias("who"), "start", "end_time")
    t = turns.select("session_id", F.col("speaker").cast("int").alias("who"), "start", "end_time").dropna()
    kinds = dict(rows.dtypes)
    schema = f"session_id {kinds['session_id']}, line_id {kinds['id']}, piece int, start double, end_time double, speaker int"
    timed = F.col("start").isNotNull() & F.col("end_time").isNotNull() & F.col("session_id").isNotNull()
    untimed = rows.where(~timed).select("session_id", F.col("id").alias("line_id"), F.lit(0).alias("piece"), "start", "end_time", F.lit(-1).alias("speaker"))

    def cut(who: np.ndarray, a: np.ndarray, b: np.ndarray, spans: pa.RecordBatch) -> pa.RecordBatch:
        every = [_pieces(start, end, who, a, b, least) for start, end in zip(spans.column("start").to_pylist(), spans.column("end_time").to_pylist(), strict=True)]
        at = pa.array(np.repeat(np.arange(len(every)), [len(p) for p in every]))
        flat = [p for parts in every for p in parts]
        place = pa.array([k for parts in every for k in range(len(parts))], pa.int32())
        cols = [pa.array([p[k] for p in flat], kind) for k, kind in ((0, pa.float64()), (1, pa.float64()), (2, pa.int32()))]
        return pa.RecordBatch.from_arrays([spans.column("session_id").take(at), spans.column("id").take(at), place, *cols], ["session_id", "line_id", "piece", "start", "end_time", "speaker"])

    return in_cells(rows.where(timed), t, cut, schema).unionByName(untimed)


def _voices(start: float, end: float, who: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[list]:
    """[from, to, who] over the utterance: at each time the turn there that began last (then the largest who), -1 where none
    is. Turns are sorted by start and who. Of turns that hold a time only those are kept that end later than all after them.
    """
    mine = np.flatnonzero((a < end) & (b > start) & (b > a))
    early = mine[a[mine] <= start][::-1]
    best = np.maximum.accumulate(b[early])
    early = early[np.concatenate([[True], best[1:] > best[:-1]])][::-1] if len(early) else early
    stack = list(zip(b[early].tolist(), who[early].tolist(), strict=True))
    late, out, at = mine[a[mine] > start], [], start

    def until(time: float) -> None:
        nonlocal at
        while at < time:
            while stack and stack[-1][0] <= at:
                stack.pop()
            to, voice = (min(stack[-1][0], time), int(stack[-1][1])) if stack else (time, -1)
            if out and out[-1][2] == voice:
                out[-1][1] = to
            else:
                out.append([at, to, voice])
            at = to

    for x, y, voice in zip(a[late].tolist(), b[late].tolist(), who[late].tolist(), strict=True):
        until(x)
        while stack and stack[-1][0] <= y:
            stack.pop()
        stack.append((y, voice))
    until(end)
    return out


def _pieces(start: float, end: float, who: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> list[list]:
    if not start < end:
        return [[min(start, end), max(start, end), -1]]
    parts = _voices(start, end, who, a, b)
    last = next((p[2] for p in parts if p[2] >= 0), -1)
    joined: list[list] = []
    for x, y, voice in parts:
        last = voice if voice >= 0 else last
        if joined and joined[-1][2] == last:
            joined[-1][1] = y
        else:
            joined.append([x, y, last])
    return _without_short(joined, least)


def _without_short(parts: list[list], least: float) -> list[list]:
    """Parts under ``least``, shortest first, then the earliest, go into the longer neighbour. A part goes by its first
    place; a heap gives the shortest, and lengths that are no longer so are passed over."""
    n = len(parts)
    size = lambda k: parts[k][1] - parts[k][0]
    before, after = [k - 1 for k in range(n)], [k + 1 for k in range(n)]
    alive, left = [True] * n, n
    heap = [(size(k), k) for k in range(n)]
    heapq.heapify(heap)

    def join(low: int, high: int) -> None:
        nonlocal left
        parts[low][1], alive[high], after[low], left = parts[high][1], False, after[high], left - 1
        if after[low] < n:
            before[after[low]] = low

    while left > 1:
        length, k = heapq.heappop(heap)
        if not alive[k] or length != size(k):
            continue
        if length >= least:
            break
        near = [i for i in (before[k], after[k]) if 0 <= i < n]
        parts[k][2] = parts[max(near, key=lambda i: (size(i), -i))][2]
        if after[k] < n and parts[after[k]][2] == parts[k][2]:
            join(k, after[k])
        if before[k] >= 0 and parts[before[k]][2] == parts[k][2]:
            k = before[k]
            join(k, after[k])
        heapq.heappush(heap, (size(k), k))
    return [p for p, there in zip(parts, alive, strict=True) if there]
