"""Stateful operators over live events. Each runs on a stream or, as its batch twin, on a table: same steps, same state."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[dict, object], list[tuple]]


def _plain(value):
    """A cell as JSON can hold it."""
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else value


def stateful(events: DataFrame, keys: list[str], order: list[str], schema: str, step: Step, late: float = 0, idle: float | None = None) -> DataFrame:
    """step(state, row) -> output rows, for the events of each key in order; state is a dict that JSON can hold.

    On a stream, ``late`` is the watermark of a key, in units of order[0]: an event waits in the state until one that much
    later in the order has come, so events in other micro-batches may still go before it. One that comes later than that
    is stepped when it comes; none is ever dropped. A key of which nothing came for ``idle`` seconds gives what still
    waits, and its state is removed; without it state stays. On a table the whole order holds.
    Output columns are those of the schema, keys included.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    Row = namedtuple("Row", events.columns)  # noqa: PYI024
    place = [events.columns.index(c) for c in order]

    def run(state: dict, rows: list) -> list[tuple]:
        return [out for row in rows for out in step(state, Row(*row))]

    def in_order(rows: list) -> list:
        return sorted(rows, key=lambda r: [r[k] for k in place])

    def listed(frame: pd.DataFrame) -> list:
        return [[_plain(v) for v in row] for row in frame.itertuples(index=False)]

    if not events.isStreaming:

        def fold(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(run({}, in_order(listed(group))), columns=names)

        return events.groupBy(*keys).applyInPandas(fold, schema)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"state": {}, "wait": [], "top": None}
        if state.hasTimedOut:
            out = run(held["state"], in_order(held["wait"]))
            state.remove()
        else:
            wait = in_order(held["wait"] + [row for f in frames for row in listed(f)])
            tops = [x for x in (held["top"], wait[-1][place[0]] if wait else None) if x is not None]
            held["top"] = max(tops, default=None)
            ripe = [r for r in wait if held["top"] - r[place[0]] >= late]
            held["wait"] = [r for r in wait if held["top"] - r[place[0]] < late]
            out = run(held["state"], ripe)
            state.update((json.dumps(held),))
            if idle:
                state.setTimeoutDuration(int(1000 * idle))
        yield pd.DataFrame(out, columns=names)

    return events.groupBy(*keys).applyInPandasWithState(update, schema, "state string", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def _cos(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size else 0.0


def _recognise(vector, known: list[tuple[str, list[float]]], floor: float, margin: float) -> str:
    best: dict[str, float] = {}
    for name, v in known:
        best[name] = max(best.get(name, -1.0), _cos(vector, v))
    ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    if not ranked or ranked[0][1] < floor or (len(ranked) > 1 and ranked[0][1] - ranked[1][1] < margin):
        return ""
    return ranked[0][0]


def assign_online(vectors: DataFrame, known: list[tuple[str, list[float]]] | None = None, threshold: float = 0.65, least: float = 1.0, recheck: int = 5, floor: float = 0.80, margin: float = 0.05, late: float = 0, idle: float | None = None) -> DataFrame:
    """(session_id, seq, channel, code, name) for vectors (session_id, seq, channel, seconds, embedding).

    The nearest centroid of the channel at the threshold joins, with a running mean; else a new code, numbered over the
    session. Short utterances go to the channel's last speaker. A voice is looked up when new and at its recheck-th
    segment. known is a short list: the prints of people.
    """
    known = known or []

    def step(state: dict, row) -> list[tuple]:
        pool, last = state.setdefault("pool", []), state.setdefault("last", {})
        if row.seconds < least and row.channel in last:
            who = next(s for s in pool if s["code"] == last[row.channel])
            return [(row.session_id, row.seq, row.channel, who["code"], who["name"])]
        v = [float(x) for x in row.embedding]
        scored = [(_cos(v, s["centroid"]), -k) for k, s in enumerate(pool) if s["channel"] == row.channel]
        best = max(scored, default=None)
        if best is None or best[0] < threshold:
            who = {"code": f"S{len(pool) + 1}", "centroid": v, "n": 0, "channel": row.channel, "name": _recognise(v, known, floor, margin)}
            pool.append(who)
        else:
            who = pool[-best[1]]
            who["centroid"] = [(c * who["n"] + x) / (who["n"] + 1) for c, x in zip(who["centroid"], v, strict=True)]
            if not who["name"] and who["n"] + 1 == recheck:
                who["name"] = _recognise(who["centroid"], known, floor, margin)
        who["n"] += 1
        last[row.channel] = who["code"]
        return [(row.session_id, row.seq, row.channel, who["code"], who["name"])]

    return stateful(vectors, ["session_id"], ["seq"], "session_id long, seq long, channel string, code string, name string", step, late, idle)


def track_language(detections: DataFrame, switch: int = 3, switch_zh_en: int = 6, pinned: frozenset[str] = frozenset(), late: float = 0, idle: float | None = None) -> DataFrame:
    """(session_id, speaker, seq, language): the language held after each detection (session_id, speaker, seq, lang).

    Two agreeing detections set it; a change needs several in a row, more between zh and en; agreement starts the count
    anew, and pinned speakers never move.
    """

    def step(state: dict, row) -> list[tuple]:
        held = state.get("held", "")
        if row.lang and row.speaker not in pinned:
            asked, n = state.get("asked", ("", 0))
            n = n + 1 if asked == row.lang else 1
            if row.lang == held:
                asked, n = "", 0
            else:
                asked = row.lang
                need = 2 if not held else switch_zh_en if {held, row.lang} == {"zh", "en"} else switch
                if n >= need:
                    held, asked, n = row.lang, "", 0
            state |= {"held": held, "asked": (asked, n)}
        return [(row.session_id, row.speaker, row.seq, held)]

    return stateful(detections, ["session_id", "speaker"], ["seq"], "session_id long, speaker string, seq long, language string", step, late, idle)


def retry_buffer(events: DataFrame, capacity: int = 24, late: float = 0, idle: float | None = None) -> DataFrame:
    """(session_id, item, action, lang) for events (session_id, seq, kind, speaker, item, lang).

    fail holds the item with the language tried, the oldest giving way at capacity (dropped). language releases what
    the speaker has held under another language (retry, once). end settles the rest: retry if the speaker's language
    has become another, else dropped.
    """

    def step(state: dict, row) -> list[tuple]:
        held, lang = state.setdefault("held", []), state.setdefault("lang", {})
        out = []
        if row.kind == "fail":
            if len(held) >= capacity:
                out.append((row.session_id, held.pop(0)[0], "dropped", ""))
            held.append([row.item, row.speaker, row.lang])
        elif row.kind == "language" and row.lang:
            lang[row.speaker] = row.lang
            out += [(row.session_id, i, "retry", row.lang) for i, s, t in held if s == row.speaker and t != row.lang]
            state["held"] = [h for h in held if not (h[1] == row.speaker and h[2] != row.lang)]
        elif row.kind == "end":
            for i, s, t in held:
                now = lang.get(s, "")
                out.append((row.session_id, i, "retry", now) if now and now != t else (row.session_id, i, "dropped", ""))
            state["held"] = []
        return out

    return stateful(events, ["session_id"], ["seq"], "session_id long, item long, action string, lang string", step, late, idle)


def remember_online(prints: DataFrame, duplicate: float = 0.85, cap: int = 8, late: float = 0, idle: float | None = None) -> DataFrame:
    """(name, seq, learned, held): does each print (name, seq, centroid) teach something, and how many are then kept."""

    def step(state: dict, row) -> list[tuple]:
        held = state.setdefault("held", [])
        near = [_cos(v, row.centroid) for v in held]
        learned = not near or max(near) < duplicate
        if learned:
            if len(held) >= cap:
                held.pop(max(range(len(held)), key=lambda k: (near[k], k)))
            held.append([float(x) for x in row.centroid])
        return [(row.name, row.seq, learned, len(held))]

    return stateful(prints, ["name"], ["seq"], "name string, seq long, learned boolean, held int", step, late, idle)


def channel_end(events: DataFrame, channels: int, late: float = 0, idle: float | None = None) -> DataFrame:
    """(session_id, seq): the event by which every channel of the session has ended. events: session_id, seq, channel."""

    def step(state: dict, row) -> list[tuple]:
        ended = state.setdefault("ended", [])
        if row.channel in ended:
            return []
        ended.append(row.channel)
        return [(row.session_id, row.seq)] if len(ended) == channels else []

    return stateful(events, ["session_id"], ["seq"], "session_id long, seq long", step, late, idle)


def merge_lines(events: DataFrame, keep: int | None = None) -> DataFrame:
    """The screen after the events (session_id, id, seq, start, source): content of the last arrival at the place of the first.

    Order is by the start the line first came with, then by first arrival; with keep, the last lines of each session.
    """
    folded = events.groupBy("session_id", "id").agg(F.max_by("source", "seq").alias("source"), F.max_by("start", "seq").alias("start"), F.min_by("start", "seq").alias("order_key"), F.min("seq").alias("first_seq"))
    w = Window.partitionBy("session_id").orderBy(F.desc("order_key"), F.desc("first_seq"))
    ranked = folded.withColumn("_r", F.row_number().over(w))
    return (ranked.where(F.col("_r") <= keep) if keep else ranked).drop("_r")


def upsert_screen(batch: DataFrame, path: str) -> None:
    """One micro-batch appended to the event table that merge_lines reads: for use in foreachBatch."""
    batch.write.mode("append").parquet(path)


def refine_previous(lines: DataFrame, revisions: DataFrame) -> DataFrame:
    """Lines revised once each, by the first revision (line_id, seq, source, translations) of a line; translations that it
    does not name stay."""
    first = revisions.groupBy("line_id").agg(F.min_by(F.struct("source", "translations"), "seq").alias("_r"))
    joined = lines.join(first, "line_id", "left")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("translations", empty), F.coalesce(F.col("_r.translations"), empty)
    kept = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    source = F.when(F.coalesce(F.col("_r.source"), F.lit("")) != "", F.col("_r.source")).otherwise(F.col("source"))
    return joined.withColumn("source", source).withColumn("translations", kept).withColumn("refined", F.col("refined") | F.col("_r").isNotNull()).drop("_r")


def live_lines(utterances: DataFrame, corrected, known: list[tuple[str, list[float]]] | None = None, threshold: float = 0.65, late: float = 0, idle: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines: session_id, seq, code, name, text; failed: utterances without text, for retry_buffer).

    utterances: session_id, seq, channel, seconds, embedding, lang, text. corrected: the correction of a text column.
    Speakers are assigned before anything is left out, since an utterance without words still is a voice.
    """
    who = assign_online(utterances.select("session_id", "seq", "channel", "seconds", "embedding"), known, threshold, late=late, idle=idle)
    joined = utterances.drop("channel").join(who, ["session_id", "seq"])
    said = F.trim(F.coalesce("text", F.lit(""))) != ""
    return joined.where(said).select("session_id", "seq", "code", "name", "lang", corrected(F.col("text")).alias("text")), joined.where(~said).select("session_id", "seq", "code", "lang")
