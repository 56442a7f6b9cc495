"""Importance resampling towards a target distribution.

Texts are bags of hashed runs of words. A bucket's gain is the log ratio of its share among the target's features and
among all documents'; a document's weight is the sum over its features, looked up in an array. Weights with a Gumbel draw
of the document's own are a sample without replacement by their order, which a sort by regular sampling finds: every task
writes a sorted run, rows at regular distances in the runs give the splitters, segments that hold a drawn row are
exchanged as sorted stretches of the runs and merged, and the counts before a segment give its rows their exact ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

BUCKETS, RUN, MIN_WORDS = 10_000, 3, 20
#: Words handled at once; segments that the drawn rows are cut into at least, the most rows of one, samples a segment.
SLICE, SEGMENTS, SEGMENT_ROWS, SAMPLES = 1 << 16, 64, 1 << 20, 8

#: A-Z in lower case; what is neither a letter, a digit nor beyond ASCII is a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _crc_table() -> np.ndarray:
    """The 256 remainders of CRC-32, from its reversed polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


class Joiner:
    """CRC-32 of two strings in a row from the CRC-32 of each and the length of the second, for arrays.

    A CRC is linear: the first string's moves on by as many zero bytes as the second has, which is one lookup in each of
    four tables of that number. Numbers beyond the tables are made of the largest one and a rest.
    """

    MOST = 64

    def __init__(self) -> None:
        one = _crc_table()
        step, tables = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)], []
        for _ in range(self.MOST + 1):
            tables.append(np.array(step))
            step = [(c >> np.uint32(8)) ^ one[c & np.uint32(255)] for c in step]
        self.tables = np.array(tables).ravel()

    def _moved(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, low = n * 1024, np.uint32(255)
        t = self.tables
        return t[at + (c & low)] ^ t[at + 256 + ((c >> np.uint32(8)) & low)] ^ t[at + 512 + ((c >> np.uint32(16)) & low)] ^ t[at + 768 + (c >> np.uint32(24))]

    def __call__(self, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self._moved(first, np.minimum(n, self.MOST))
        if n.max(initial=0) > self.MOST:
            for k in np.flatnonzero(n > self.MOST):
                whole, rest = divmod(int(n[k]), self.MOST)
                c = first[k : k + 1]
                for step in [self.MOST] * whole + [rest]:
                    c = self._moved(c, np.array([step]))
                out[k] = c[0]
        return out ^ second


def features(texts: Iterable[bytes], join: Joiner, run: int = RUN, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each word, text of each feature, bucket of each feature) of whole texts, about SLICE words at a time.

    A feature is a run of 1 to ``run`` words of one text, joined by a blank; its bucket is its crc32 modulo the buckets.
    The last words of a slice are carried into the next, where a text may go on.
    """
    held = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    words: list[bytes] = []
    owner: list[int] = []
    length: list[int] = []

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal held
        n, before = len(words), len(held[0])
        crc, size, of = np.fromiter(map(zlib.crc32, words), np.uint32, n), np.fromiter(map(len, words), np.int64, n), np.repeat(np.array(owner, np.int64), length)
        grown = join(np.full(n, zlib.crc32(b" "), np.uint32), crc, size)
        crc, grown, size, of = (np.concatenate(x) for x in zip(held, (crc, grown, size + 1, of), strict=True))
        ends, found, whose = crc, [crc[before:]], [of[before:]]
        for k in range(1, run):
            # Runs of k + 1 words, by the place of their last word; new if that word is.
            ends = join(ends[:-1], grown[k:], size[k:])
            fresh = slice(max(0, before - k), None)
            inside = (of[k:] == of[:-k])[fresh]
            found.append(ends[fresh][inside])
            whose.append(of[k:][fresh][inside])
        keep = max(0, len(crc) - run + 1)
        held = crc[keep:], grown[keep:], size[keep:], of[keep:]
        for x in (words, owner, length):
            x.clear()
        return whose[0], np.concatenate(whose), np.concatenate(found).astype(np.int64) % buckets

    for k, raw in enumerate(texts):
        own = raw.translate(_FOLD).split()
        for at in range(0, len(own), SLICE):
            some = own[at : at + SLICE]
            words += some
            owner.append(k)
            length.append(len(some))
            if len(words) >= SLICE:
                yield settle()
    if words:
        yield settle()


def _raw(texts: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts)


def _counted(run: int, buckets: int, min_words: int):
    """(bucket, n) of a task's texts; bucket -1 counts the texts of min_words words or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, counts, texts = Joiner(), np.zeros(buckets, np.int64), 0
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for word, _, found in features(_raw(b.column(0)), join, run, buckets):
                counts += np.bincount(found, minlength=buckets)
                n += np.bincount(word, minlength=len(n))
            texts += int((n >= min_words).sum())
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(counts[own], texts))], ["bucket", "n"])

    return rows


def bucket_counts(docs: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS) -> tuple[np.ndarray, int]:
    """Features of each bucket over all texts, and how many texts have min_words words or more."""
    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_counted(run, buckets, min_words), "bucket long, n long")
    counts, texts = np.zeros(buckets, np.int64), 0
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            texts = r["n"]
        else:
            counts[r["bucket"]] = r["n"]
    return counts, texts


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the corpus, each count raised by one."""
    t, s, k = float(target.sum()), float(corpus.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((a + 1.0) * (s + k) / ((b + 1.0) * (t + k)))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def _scored(gain: np.ndarray, run: int, min_words: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Joiner()
        for b in batches:
            n_words, n_features, weight = np.zeros((3, b.num_rows), np.int64)
            for word, of, found in features(_raw(b.column(2)), join, run, len(gain)):
                n_words += np.bincount(word, minlength=len(n_words))
                n_features += np.bincount(of, minlength=len(n_words))
                # Sums of integers below 2**53: exact.
                weight += np.bincount(of, gain[found], len(n_words)).astype(np.int64)
            hashes = (int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16) for name in b.column(1).to_pylist())
            draw = np.fromiter((math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in hashes), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_features, weight, weight + draw, n_words >= min_words))], ["id", "n_features", "weight", "score", "open"])

    return rows


_ROW = ["n_features", "weight", "score", "run", "place"]


def _key(score: int, name: object, run: int, place: int) -> tuple:
    return -score, name is None, name, run, place


def _segments(splitters: list[tuple]):
    """The segment of each row of sorted stretches: how many splitters are not after it."""
    first = np.array([s[0] for s in splitters], np.int64)

    def of(b: pa.RecordBatch) -> np.ndarray:
        score = -b.column("score").to_numpy()
        low, high = np.searchsorted(first, score, side="left"), np.searchsorted(first, score, side="right")
        for k in np.flatnonzero(low < high).tolist():
            # The score of a splitter: the rest of the key decides.
            r = {c: b.column(c)[k].as_py() for c in ("score", "id", "run", "place")}
            low[k] = bisect_right(splitters, _key(r["score"], r["id"], r["run"], r["place"]), int(low[k]), int(high[k]))
        return low

    return of


def _sizes(splitters: list[tuple]):
    of = _segments(splitters)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(splitters) + 1, np.int64)
        for b in batches:
            counts += np.bincount(of(b), minlength=len(counts))
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], ["segment", "n"])

    return rows


def _stretches(splitters: list[tuple], last: int):
    """Each sorted stretch of a run within a segment as one row of arrays, up to segment ``last``; one row each after it."""
    of = _segments(splitters)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segment, run = of(b), b.column("run").to_numpy()
            cut = np.flatnonzero((np.diff(segment, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
            at = cut[segment[cut] <= last]
            ends = np.append(cut, len(segment))[np.searchsorted(cut, at) + 1]
            keep = pa.array(np.repeat(at - np.concatenate([[0], np.cumsum(ends - at)[:-1]]).astype(np.int64), ends - at) + np.arange((ends - at).sum())) if len(at) else pa.array([], pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum(ends - at)]).astype(np.int32))
            held = [pa.ListArray.from_arrays(offsets, b.column(c).take(keep)) for c in ("id", *_ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(segment[at]), *held], ["segment", "id", *_ROW])

    return rows


def _after(splitters: list[tuple], last: int):
    """The rows of later segments, which no rank reaches."""
    of = _segments(splitters)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(of(b) > last)).select(["id", "n_features", "weight", "score"])

    return rows


def _merged(before: np.ndarray, drawn: int):
    """Merges the stretches of one segment; ranks count on from the segments before."""

    def of(t: pa.Table) -> pa.Table:
        segment = t["segment"][0].as_py()
        flat = pa.table({c: pc.list_flatten(t[c].combine_chunks()) for c in ("id", *_ROW)})
        flat = flat.take(pc.sort_indices(flat, sort_keys=[("score", "descending"), ("id", "ascending"), ("run", "ascending"), ("place", "ascending")]))
        rank = before[segment] + 1 + np.arange(len(flat))
        return flat.select(["id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, mask=rank > drawn))

    return of


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5, run: int = RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = 42) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank (null where it is not drawn).

    A null text has no words; an empty target or corpus leaves every bucket its one added count. Of the N rows with
    min_words words or more, floor(percent * N / 100) are drawn: highest scores first, of equal scores smaller ids, a null
    id last. Rows that agree in id and score are drawn one by one, in the order of their runs. A null id draws as ``None``
    written out. An empty table gives an empty result. Other columns are not read. Ids are integers or strings.
    """
    corpus, eligible = bucket_counts(docs, text_col, run, buckets, min_words)
    gain = gains(bucket_counts(target, target_text, run, buckets)[0], corpus)
    drawn = percent * eligible // 100
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    plain = f"id {id_type}, n_features long, weight long, score long"
    scored = slim.mapInArrow(_scored(gain, run, min_words, seed), f"{plain}, open boolean")
    # A task's rows sorted: its run. Places are kept, so that equal rows are in order too.
    ordered = scored.sortWithinPartitions(F.desc("open"), F.desc("score"), F.asc_nulls_last("id"))
    runs = save(ordered.withColumn("run", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id()), "runs")
    open_ = runs.where("open")
    none = F.lit(None).cast("long").alias("rank")
    rest = runs.where("NOT open").select("id", "n_features", "weight", "score", none)
    rows = min(SEGMENT_ROWS, max(1, drawn // SEGMENTS))
    splitters = _splitters(open_, rows)
    sizes = np.zeros(len(splitters) + 1, np.int64)
    for r in open_.mapInArrow(_sizes(splitters), "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n")).collect():
        sizes[r["segment"]] = r["n"]
    before = np.cumsum(sizes) - sizes
    last = int(np.searchsorted(before, drawn, side="left")) - 1
    listed = ", ".join(f"{c} array<{id_type if c == 'id' else 'long'}>" for c in ("id", *_ROW))
    head = splitters[: last + 1]
    met = open_.mapInArrow(_stretches(head, last), f"segment long, {listed}").groupBy("segment").applyInArrow(_merged(before[: last + 1], drawn), f"{plain}, rank long")
    later = open_.mapInArrow(_after(head, last), plain).select("*", none)
    return met.unionByName(later).unionByName(rest).withColumnRenamed("id", id_col)


def _splitters(open_: DataFrame, rows: int) -> list[tuple]:
    """Keys that cut the runs into segments of about so many rows: every SAMPLES-th of the samples, which lie at regular
    distances in each run, from a start of the run's own. They grow with the rows over SEGMENT_ROWS / SAMPLES at most."""
    step = max(1, rows // SAMPLES)
    at: Column = F.pmod(F.col("place").bitwiseAND((1 << 33) - 1) + F.pmod(F.xxhash64("run"), F.lit(step)), F.lit(step))
    found = open_.where(at == 0).select("score", "id", "run", "place").toArrow()
    keys = sorted(_key(*r) for r in zip(*(found[c].to_pylist() for c in ("score", "id", "run", "place")), strict=True))
    return keys[SAMPLES - 1 :: SAMPLES]
