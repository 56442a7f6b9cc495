"""Benchmark decontamination by greedy string tiling.

Windows of a few tokens, hashed as Karp-Rabin polynomials, are the seeds. Documents and benchmark items meet in an
equi-join on seeds; what comes out for one (document, item) is small, and there the longest common runs of seeds are
marked one after another, never overlapping, so that reordered passages still cover the item.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, save, whole

_TOKEN = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15
#: The seed filter is sent to the tasks only up to so many distinct seeds (8 bytes each), and the items' seeds only up to
#: so many rows and places of them; beyond it Spark joins.
MAX_FILTER = 1_000_000


def tokens_of(text: str | None) -> np.ndarray:
    """A hash of each token; tokens are case-folded runs of letters and digits."""
    found = _TOKEN.findall((text or "").casefold())
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of so many tokens."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + h[k : n - width + 1 + k]
    return out


def _seed_rows(widths: list[int], wanted: np.ndarray | None, own: bool = False):
    """(id, row, n, seed, at): the places of each seed of a text, wanted ones only. The seeds are windows of all the widths,
    or, for the text's own, of the last width or the whole text if that is shorter."""
    if wanted is not None:
        table = np.zeros(1 << 22, bool)
        table[wanted >> np.uint64(42)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick, n_of, seed_of, at_of = [], [], [], []
            for k, text in enumerate(b.column(2)):
                tokens = tokens_of(text.as_py())
                n = len(tokens)
                if not n:
                    continue
                each = [windows(tokens, w) for w in ([min(widths[-1], n)] if own else widths)]
                h, at = np.concatenate(each), np.concatenate([np.arange(len(x)) for x in each])
                if wanted is not None:
                    some = np.flatnonzero(table[h >> np.uint64(42)])
                    if len(some):
                        near = np.searchsorted(wanted, h[some])
                        some = some[wanted[np.minimum(near, len(wanted) - 1)] == h[some]]
                    h, at = h[some], at[some]
                if not len(at):
                    continue
                places = defaultdict(list)
                for s, p in zip(h.tolist(), at.tolist(), strict=True):
                    places[s].append(p)
                pick += [k] * len(places)
                n_of += [n] * len(places)
                seed_of += list(places)
                at_of += list(places.values())
            chosen = pa.array(pick, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(chosen), b.column(1).take(chosen), pa.array(n_of, pa.int32()), pa.array(np.array(seed_of, np.uint64).view(np.int64)), pa.array(at_of, pa.list_(pa.int32()))],
                ["id", "row", "n", "seed", "at"],
            )

    return run


def tile(d: np.ndarray, i: np.ndarray, width: int, n_item: int) -> tuple[int, int]:
    """(tokens of the item that tiles cover, number of tiles) from the places (d, i) of equal windows.

    The longest run goes first; of equals the one that starts first in the document, then in the item.
    """
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    new = np.flatnonzero((np.diff(d - i) != 0) | (np.diff(d) != 1)) + 1
    first = np.concatenate([[0], new])
    length = np.diff(np.concatenate([first, [len(d)]])) + width - 1
    heap = [(-int(n), int(d[k]), int(i[k])) for k, n in zip(first, length, strict=True)]
    heapq.heapify(heap)
    low = int(d.min())
    used_d, used_i, tiles = np.zeros(int(d.max()) - low + width, bool), np.zeros(n_item, bool), 0
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = used_d[a - low : a - low + n] | used_i[b : b + n]
        if not taken.any():
            used_d[a - low : a - low + n] = True
            used_i[b : b + n] = True
            tiles += 1
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= width:
                heapq.heappush(heap, (-(e - s), a + s, b + s))
    return int(used_i.sum()), tiles


def _tile_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covered, tiles = [], []
            for n, pairs in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                cells = [np.array(np.meshgrid(p["d"], p["i"])).reshape(2, -1) for p in pairs]
                d, i = np.concatenate(cells, axis=1)
                c, t = tile(d, i, min(width, n), n)
                covered.append(c)
                tiles.append(t)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(covered, pa.int32()), pa.array(tiles, pa.int32())], ["id", "row", "item_id", "n_item_tokens", "matched_tokens", "n_tiles"])

    return run


def row_key(docs: DataFrame, id_col: str, text_col: str):
    return F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text_col}`"])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    coverage: float = 0.5,
    max_filter: int = MAX_FILTER,
) -> DataFrame:
    """(id, row, item_id, n_item_tokens, matched_tokens, n_tiles, coverage) of pairs at or over the coverage.

    row tells rows of the same id but different text apart. Tiles are at least min_match tokens long, or
    the whole item if it has fewer; null texts and texts without a token never match. Equal items each report. Rows repeated in full report once.
    Null ids are ids like others. An empty table on either side gives an empty result. Further columns are not read.
    """
    spark = docs.sparkSession
    shape = "n int, seed long, at array<int>"
    items = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.xxhash64(benchmark[item_text_col]).alias("row"), F.col(f"`{item_text_col}`").alias("text"))
    id_type = items.schema["id"].dataType.simpleString()
    item_seeds = save(items.distinct().mapInArrow(_seed_rows([min_match], None, own=True), f"id {id_type}, row long, {shape}"), "item-seeds")
    distinct = item_seeds.select("seed").distinct()
    got = [r["seed"] for r in distinct.limit(max_filter + 1).collect()]
    wanted = np.sort(np.array(got, np.int64).view(np.uint64)) if len(got) <= max_filter else None
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(docs, id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))
    doc_type = texts.schema["id"].dataType.simpleString()
    # Documents come with windows as wide as items ask for: at most min_match widths.
    widths = sorted(r["w"] for r in item_seeds.select(F.least("n", F.lit(min_match)).alias("w")).distinct().collect())
    doc_seeds = save(texts.mapInArrow(_seed_rows(widths or [min_match], wanted), f"id {doc_type}, row long, {shape}"), "doc-seeds")
    # Items that share text have few distinct seeds and many rows, so what is sent is counted by itself.
    sent = item_seeds.agg(F.coalesce(F.sum(1 + F.size("at")), F.lit(0)).alias("n")).first()["n"]
    right = item_seeds.select("seed", F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("n").alias("n_item_tokens"), F.col("at").alias("i"))
    met = doc_seeds.select("id", "row", "seed", F.col("at").alias("d")).distinct().join(F.broadcast(right) if sent <= max_filter else right, "seed")
    # Fewer distinct windows than the coverage needs can not reach it.
    pairs = met.groupBy("id", "row", "item_id", "item_row", "n_item_tokens").agg(F.collect_list(F.struct("d", "i")).alias("pairs"))
    places = F.aggregate("pairs", F.lit(0), lambda a, p: a + F.size(p["i"]))
    likely = pairs.where(places * F.least(F.lit(min_match), F.col("n_item_tokens")) >= F.col("n_item_tokens") * coverage).select("id", "row", "item_id", "n_item_tokens", "pairs")
    item_type = right.schema["item_id"].dataType.simpleString()
    tiled = likely.mapInArrow(_tile_rows(min_match), f"id {doc_type}, row long, item_id {item_type}, n_item_tokens int, matched_tokens int, n_tiles int")
    share = F.col("matched_tokens") / F.col("n_item_tokens")
    return tiled.withColumn("coverage", share).where(share >= coverage).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that contain a benchmark item.

    Rows of one id are judged by their own texts, null ids too; rows repeated in full go or stay together. Null and short
    texts stay. Without items every row stays, and an empty table gives an empty result. Columns of any name stay.
    """
    bad = save(contaminated(docs, benchmark, id_col, text_col, **how).select(F.col(f"`{id_col}`").alias("id"), "row").distinct(), "contaminated")
    own = docs.select(whole(docs.columns), row_key(docs, id_col, text_col).alias("key"))
    return own.join(bad, F.col(f"doc.`{id_col}`").eqNullSafe(bad["id"]) & (own["key"] == bad["row"]), "left_anti").select(*parts(docs.columns))
