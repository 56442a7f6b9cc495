"""A quality classifier without gold labels.

Overlapping heuristic labellers vote on each text. Expectation-maximisation over the counts of vote patterns estimates
how accurate each labeller is and gives every pattern a posterior. The posteriors train a linear scorer over hashed
words: weights are log ratios of the hashed counts of good and bad texts, and one line maps a text's mean weight to a
probability. Every step is one pass over the texts whose result is bounded by the patterns, the hash size or the bins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?"
BUCKETS = 1 << 14


def _vote(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """+1 inside good, -1 outside bad, else no vote."""
    return 1 if good[0] <= value <= good[1] else -1 if value < bad[0] or value > bad[1] else 0


#: name: (what it measures of the text, range that votes good, range outside which it votes bad)
LABELLERS = {
    "length": ((50, math.inf), (10, math.inf)),
    "word_length": ((3.0, 7.0), (2.5, 9.0)),
    "symbols": ((0.0, 0.02), (0.0, 0.2)),
    "capitals": ((0.0, 0.08), (0.0, 0.35)),
    "distinct": ((0.5, 1.0), (0.3, 1.0)),
    "lines": ((0.0, 0.02), (0.0, 0.3)),
    "short_words": ((0.15, 0.7), (0.05, 0.9)),
    "marks": ((0.03, 0.4), (0.01, 1.0)),
    "letters": ((0.97, 1.0), (0.8, 1.0)),
}


#: How often a labeller votes on texts of either kind, before anything is seen.
GOOD_PRIOR, BAD_PRIOR = {-1: 0.005, 0: 0.3, 1: 0.695}, {-1: 0.3, 0: 0.35, 1: 0.35}


def measures(text: bytes, words: list[bytes]) -> tuple[float, ...]:
    n = max(1, len(words))
    size = max(1, sum(map(len, words)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda kept: len(text) - len(text.translate(None, kept))
    return (
        len(words),
        size / n,
        count(SYMBOLS) / n,
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) <= 3 for w in words) / n,
        count(MARKS) / n,
        sum(bool(w.strip(SYMBOLS + MARKS + b"0123456789")) for w in words) / n,
    )


def pattern(text: bytes, words: list[bytes]) -> int:
    """The votes as one number, base 3."""
    code = 0
    for value, (good, bad) in zip(measures(text, words), LABELLERS.values(), strict=True):
        code = code * 3 + _vote(value, good, bad) + 1
    return code


def votes_of(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return tuple(reversed(out))


def estimate(counts: dict[int, int], rounds: int = 60, trust: float = 0.1) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """({pattern: posterior of good}, accuracy of each labeller on good and on bad texts) by expectation-maximisation.

    A vote against is taken to be rare on good texts: that is the first posterior, and a prior worth ``trust`` of the
    texts keeps it so, which also fixes which class is which.
    """
    rows = [(c, votes_of(c), n) for c, n in sorted(counts.items())]
    post = {c: 1 / (1 + math.exp(4 * sum(x < 0 for x in v) - 2)) for c, v, _ in rows}
    weight = trust * sum(n for _, _, n in rows) + 1
    table: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        total = sum(n for _, _, n in rows) + 2
        prior = (sum(post[c] * n for c, _, n in rows) + 1) / total
        table = []
        for j in range(len(LABELLERS)):
            yes, no = {x: weight * y for x, y in GOOD_PRIOR.items()}, {x: weight * y for x, y in BAD_PRIOR.items()}
            for c, v, n in rows:
                yes[v[j]] += post[c] * n
                no[v[j]] += (1 - post[c]) * n
            table.append({x: (yes[x] / sum(yes.values()), no[x] / sum(no.values())) for x in (-1, 0, 1)})
        for c, v, _ in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[x][0] / t[x][1]) for t, x in zip(table, v, strict=True))
            post[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    right = [(t[1][0] / (t[1][0] + t[-1][0]), t[-1][1] / (t[1][1] + t[-1][1])) for t in table]
    return post, right


def hashed(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)


def _texts(batches: Iterator[pa.RecordBatch], column: int):
    for b in batches:
        for t in b.column(column):
            text = t.as_buffer().to_pybytes() if t.is_valid else b""
            yield text, text.split()


def _pattern_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, int] = {}
    for text, words in _texts(batches, 0):
        code = pattern(text, words)
        held[code] = held.get(code, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64())], ["pattern", "n"])


def _weight_rows(post: dict[int, float], buckets: int):
    """Each task's hashed shares of good and bad texts; a text counts once, however long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = np.zeros(buckets), np.zeros(buckets)
        for text, words in _texts(batches, 0):
            if words:
                share = np.bincount(hashed(words, buckets), minlength=buckets) / len(words)
                p = post[pattern(text, words)]
                good += p * share
                bad += (1 - p) * share
        at = np.flatnonzero(good + bad)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(good[at]), pa.array(bad[at])], ["bucket", "good", "bad"])

    return run


def _mean_weight(words: list[bytes], weights: np.ndarray) -> float:
    return float(weights[hashed(words, len(weights))].mean()) if words else -8.0


def _bin_rows(post: dict[int, float], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[float]] = {}
        for text, words in _texts(batches, 0):
            x = held.setdefault(round(_mean_weight(words, weights) * 32), [0, 0.0])
            x[0] += 1
            x[1] += post[pattern(text, words)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.float64())], ["bin", "n", "good"])

    return run


def fit_line(bins: list[tuple[float, float, float]], steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of a logistic line through (value, rows, good rows), by Newton's method with a light ridge."""
    a, b = 1.0, 0.0
    x, n, g = (np.array(c, float) for c in zip(*bins, strict=True)) if bins else (np.zeros(0),) * 3
    for _ in range(steps if bins else 0):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = np.array([((p * n - g) * x).sum() + 1e-2 * a, (p * n - g).sum() + 1e-2 * b])
        w = p * (1 - p) * n
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a, b


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, weak_label (posterior of its votes), score (of the linear scorer), kept.

    Null texts count as empty. Repeated rows each keep a row and a vote. An empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"), F.col(f"`{id_col}`").alias("id"))
    texts = slim.select("text")
    counts = texts.mapInArrow(_pattern_rows, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    post, _ = estimate({r["pattern"]: r["n"] for r in counts})
    got = texts.mapInArrow(_weight_rows(post, buckets), "bucket int, good double, bad double").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    sums = np.full((buckets, 2), 1e-2)
    at = got["bucket"].to_numpy()
    if len(at):
        sums[at, 0] += got["good"].to_numpy()
        sums[at, 1] += got["bad"].to_numpy()
    weights = np.log(sums[:, 0] / sums[:, 0].sum()) - np.log(sums[:, 1] / sums[:, 1].sum())
    bins = texts.mapInArrow(_bin_rows(post, weights), "bin int, n long, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
    slope, offset = fit_line(sorted((r["bin"] / 32, r["n"], r["good"]) for r in bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = [], []
            for text, words in _texts([b], 0):
                label.append(post[pattern(text, words)])
                z = slope * _mean_weight(words, weights) + offset
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(label, pa.float64()), pa.array(score, pa.float64())], ["id", "weak_label", "score"])

    id_type = slim.schema["id"].dataType.simpleString()
    scored = slim.mapInArrow(run, f"id {id_type}, weak_label double, score double")
    return scored.withColumn("kept", F.col("score") >= threshold).withColumnRenamed("id", id_col)
