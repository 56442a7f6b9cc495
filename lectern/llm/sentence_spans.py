"""Substring dedup on sliding sentence spans.

Every run of a few consecutive sentences is hashed. A span's first place is the smallest row that has it, and there its
first occurrence; every sentence that lies in another occurrence goes. Spans are counted first; of those that rows share, the
first row comes from a grouped minimum, which combines before the shuffle, and the rows then join on the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, parts, save, whole

_CUT = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|\n")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A sentence of so many words or more is cut. A passage of 51 words holds three whole pieces wherever it starts: at
#: most 9 words go before its first cut and 10 after its last.
WINDOW = 10


def pieces(text: str, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes of the words in lower case, first word of each piece and the number of words).

    A sentence ends after . ! or ? before a blank, or at a line's end. A sentence of ``window`` words or more is cut
    before the word of least hash in each run of window words, so where it is cut depends on the words around alone.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if not n:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.zeros(1, np.int64))
    starts, ends = np.array(spans, np.int64).T
    # bytes.split() cuts at the same six blanks; str.split() cuts at more.
    h = np.fromiter(map(xxhash.xxh64_intdigest, text.lower().encode("utf-8", "surrogatepass").split()), np.uint64, n)
    stops = np.fromiter((m.start() for m in _CUT.finditer(text)), np.int64)
    # The sentence of a word: how many stops lie before it.
    sentence = np.searchsorted(stops, starts, side="right")
    new = np.flatnonzero(np.diff(sentence, prepend=-1))
    if n >= window:
        least = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1) + np.arange(n - window + 1)
        inside = sentence[: n - window + 1] == sentence[window - 1 :]
        new = np.union1d(new, least[inside])
    return starts, ends, h, np.append(new, n)


#: Odd bases of two polynomials modulo 2**64 and their inverses: a run's hash is a difference of two prefix sums.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number."""
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(times)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def run_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of words first:end, from prefix sums over all words; equal runs have equal ones."""
    out = []
    for k, (base, inverse) in enumerate(zip(_BASES, _INVERSES, strict=True)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_mixed(h) if k else h) * _powers(base, len(h)))])
        run = (sums[end] - sums[first]) * _powers(inverse, len(h) + 1)[first]
        out.append(_mixed(run + (end - first).astype(np.uint64)))
    return out[0], out[1] >> np.uint64(32)


def span_hashes(text: str, run: int, min_words: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, start, end, again) of every run of ``run`` pieces, each made longer until it has min_words words; again
    tells that the text had the same run before.

    A text of fewer pieces is one span as a whole, if it has the words.
    """
    starts, ends, h, cut = pieces(text, window)
    n = len(cut) - 1
    if len(h) < min_words or not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2, np.empty(0, bool)
    last = np.maximum(np.arange(n) + run, np.searchsorted(cut, cut[:-1] + min_words))
    if n < run:
        last = np.full(1, n)
    last = last[last <= n]
    first, end = cut[: len(last)], cut[last]
    span, check = run_hashes(h, first, end)
    order = np.lexsort((np.arange(len(span)), check, span))
    again = np.zeros(len(span), bool)
    again[order[1:]] = (span[order[1:]] == span[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    return span, check, starts[first], ends[end - 1], again


def _span_rows(run: int, window: int, min_words: int):
    types = np.int64, np.int32, np.int32, np.int32, bool

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [span_hashes(text.as_py() or "", run, min_words, window) for text in b.column(2)]
            pick = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            # Unsigned numbers keep their bits.
            cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0)] * 5
            cols = [c.view(np.int64) if c.dtype == np.uint64 else c for c in cols]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), *(pa.array(c.astype(t)) for c, t in zip(cols, types, strict=True))], ["id", "row", "span", "check", "start", "end", "again"])

    return rows


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, window: int = WINDOW, min_words: int = 10) -> DataFrame:
    """(id, row, first_ids, removed): what each text loses, as merged ranges of code points.

    Texts that lose nothing have no row. A span of fewer than min_words words goes on until it has them, and a text of
    fewer than ``run`` sentences is one span; a text under min_words has none. Words are compared in lower case and
    blanks do not matter. Null texts have no sentence. Rows are told apart by id and text, null ids too: the first is
    the one of the smallest id, null before all others, then by a hash of its text. Rows repeated in full lose the
    same. An empty table gives an empty result. Columns of docs other than the two are not read.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    rows = save(slim.mapInArrow(_span_rows(run, window, min_words), f"id {id_type}, row long, span long, check int, start int, end int, again boolean"), "spans")
    once = rows.where(~F.col("again"))
    # Most spans occur once. A count of each tells, and moves eight bytes a span; only the others go further.
    many = once.groupBy("span").agg(F.count("*").alias("n")).where("n > 1").select("span")
    met = save(once.join(many, "span", "left_semi"), "met")
    # Written, so that Spark knows its size and can split a span that very many rows have.
    firsts = save(met.groupBy("span", "check").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    other = met.join(firsts, ["span", "check"]).where((F.col("row") != F.col("first.row")) | ~F.col("id").eqNullSafe(F.col("first.id")))
    lost = other.select("id", "row", "start", "end", F.col("first.id").alias("first_id")).unionByName(rows.where("again").select("id", "row", "start", "end", F.col("id").alias("first_id")))
    per_row = lost.groupBy("id", "row").agg(F.sort_array(F.collect_set("first_id")).alias("first_ids"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        "all",
        F.struct(none.alias("done"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")),
        lambda a, x: F.when(a["end"].isNull(), F.struct(a["done"].alias("done"), x["start"].alias("start"), x["end"].alias("end")))
        .when(x["start"] <= a["end"], F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["end"], x["end"]).alias("end")))
        .otherwise(F.struct(F.array_append(a["done"], F.struct(a["start"].alias("start"), a["end"].alias("end"))).alias("done"), x["start"].alias("start"), x["end"].alias("end"))),
        lambda a: F.array_append(a["done"], F.struct(a["start"].alias("start"), a["end"].alias("end"))),
    )
    return per_row.select(F.col("id").alias(id_col), "row", "first_ids", merged.alias("removed"))


def cut(text, ranges):
    """The text without the ranges, each replaced by nothing; ranges are sorted and apart."""
    done = F.aggregate(
        ranges,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"])).alias("out")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the repeated sentences cut out of the text, and ``removed`` (null where nothing was).

    Null ids, null and short texts, repeated rows and empty tables as in repeated_spans: every row of docs has a row. If
    docs has a column ``removed`` it stays as it is, and the new one gets an underscore.
    """
    lost = repeated_spans(docs, id_col, text_col, **how).select("row", "removed")
    keyed = docs.select(whole(docs.columns), row_key(id_col, text_col).alias("row"))
    joined = keyed.join(lost, "row", "left")
    text = F.col(f"doc.`{text_col}`")
    new = F.when(F.col("removed").isNull(), text).otherwise(cut(text, F.col("removed"))).alias(text_col)
    own = [new if c == text_col else p for c, p in zip(docs.columns, parts(docs.columns), strict=True)]
    return joined.select(*own, F.col("removed").alias(fresh(docs.columns, "removed")))
