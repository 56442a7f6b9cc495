"""Near duplicates by SimHash, with candidates from the pigeonring principle.

A fingerprint is read as a ring of segments. If two differ in at most t bits, some segment starts a chain in which
the first l segments differ in at most floor(l * t / m) bits together, for every l up to m. The longest part with a
budget of 0 and half of the part with a budget of 1 make exact keys, so candidates come from sorting by key; the
chain's budgets are then tried in turn, and the full Hamming distance last. A bucket gives the edges of a spanning
forest, never all its pairs, and components come from alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save

#: Fingerprints of one bucket that one task compares at once; larger buckets are cut into pairs of blocks.
MAX_BUCKET = 16_384


def _fingerprint(text: bytes | None, shingle: int) -> bytes:
    w = (text or b"").lower().split()
    if not w:
        return bytes(8)
    joined, n = b" ".join(w), max(1, len(w) - shingle + 1)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    cuts = map(joined.__getitem__, map(slice, starts, ends[-n:].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    big = h.astype(">u8").view(np.uint8).reshape(n, 8)
    for k in range(0, n, 4096):
        ones += np.unpackbits(big[k : k + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64 bits of each whole text as a long. A text without words, or null, gets 0."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [int.from_bytes(_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle), "big", signed=True) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    id_type = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {id_type}, fp long")


def ring(max_bits: int, segments: int = 16) -> tuple[int, int, int]:
    """(segments, how many from the start of a chain have budget 0, how many budget 1 at most)."""
    zero = max(x for x in range(segments + 1) if x * max_bits // segments == 0)
    one = max(x for x in range(segments + 1) if x * max_bits // segments <= 1)
    return segments, zero, one


def ring_keys(fp: Column, max_bits: int) -> Column:
    """The keys of a fingerprint: for each start, the zero-budget part with either half of the next part.

    The next part may differ in one bit, so one of its halves is equal.
    """
    m, zero, one = ring(max_bits)
    bits, half = 64 // m, (one - zero) // 2
    keys = []
    for start in range(m):
        turned = fp if start == 0 else F.shiftleft(fp, bits * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits * start))
        head = F.shiftrightunsigned(turned, 64 - bits * zero)
        parts = [(zero, half), (zero + half, one - zero - half)] if max_bits > 1 else [(zero, 0)]
        for side, (at, width) in enumerate(parts):
            tail = F.shiftrightunsigned(F.shiftleft(turned, bits * at), 64 - bits * width) if width else F.lit(0).cast("long")
            key = F.shiftleft(head, bits * width).bitwiseOR(tail)
            keys.append(F.struct(F.lit(start * 2 + side).cast("int").alias("tab"), key.alias("key")))
    return F.array(*keys)


def _chain(a: np.ndarray, b: np.ndarray, start: int, max_bits: int) -> np.ndarray:
    """Where the chain from start keeps every budget; the last budget is the full Hamming check."""
    m = ring(max_bits)[0]
    bits = 64 // m
    x = a ^ b
    if start:
        x = (x << np.uint64(bits * start)) | (x >> np.uint64(64 - bits * start))
    good = np.ones(len(x), bool)
    for budget in range(max_bits):
        longest = max(k for k in range(m + 1) if k * max_bits // m <= budget)
        if not longest:
            continue
        good &= np.bitwise_count(x >> np.uint64(64 - bits * longest)) <= budget
    return good & (np.bitwise_count(x) <= max_bits)


def _forest(fps: np.ndarray, start: int, max_bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the linked fingerprints of one bucket."""
    left, src, dst = fps, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            good = _chain(left, at, start, max_bits)
            if good.any():
                found = left[good]
                src += [int(at)] * len(found)
                dst += found.tolist()
                queue += list(found)
                left = left[~good]
    return src, dst


def _bucket_edges(max_bits: int, most: int):
    """Reads rows (tab, key, lo, hi, fp) sorted by all but the last; gives edges, and the rows of buckets over most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(4)] + [np.empty(0, np.uint64)]
        over = None  # the bucket whose rows are being passed on

        def edges(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
            src: list[int] = []
            dst: list[int] = []
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            tab, fp = cols[0], cols[4]
            for start in np.unique(tab[two] >> 1) if len(two) else ():
                at = two[tab[two] >> 1 == start]
                good = at[_chain(fp[at], fp[at + 1], int(start), max_bits)]
                src += fp[good].tolist()
                dst += fp[good + 1].tolist()
            for k in np.flatnonzero(size > 2):
                a, b = _forest(fp[cuts[k] : cuts[k + 1]], int(tab[cuts[k]]) >> 1, max_bits)
                src += a
                dst += b
            return rows(src, dst)

        def rows(src, dst, tab=None, key=None) -> pa.RecordBatch:
            n = len(src)
            signed = [pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (src, dst)]
            tabs = pa.array(np.full(n, -1, np.int32) if tab is None else np.asarray(tab, np.int32))
            return pa.RecordBatch.from_arrays([tabs, pa.array(np.zeros(n, np.int64) if key is None else key), *signed], ["tab", "key", "src", "dst"])

        for b in batches:
            new = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            new[4] = new[4].view(np.uint64)
            cols = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(cols[0]):
                continue
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            if over is not None:
                end = int(change[0]) if len(change) else len(cols[0])
                if tuple(c[0] for c in cols[:4]) != over:
                    end, over = 0, None
                elif end < len(cols[0]):
                    over = None
                if end:
                    yield rows(cols[4][:end], cols[4][:end], cols[0][:end], cols[1][:end])
                    cols = [c[end:] for c in cols]
                    change = change[change > end] - end
                if not len(cols[0]):
                    held = [c[:0] for c in cols]
                    continue
            last = int(change[-1]) if len(change) else 0
            if last:
                yield from whole(cols, np.concatenate([[0], change]), edges, rows)
            held = [c[last:] for c in cols]
            if len(held[0]) > most:
                over = tuple(c[0] for c in held[:4])
                yield rows(held[4], held[4], held[0], held[1])
                held = [c[:0] for c in held]
        if len(held[0]) > 1:
            yield from whole(held, np.array([0, len(held[0])]), edges, rows)

    def whole(cols, cuts, edges, rows):
        """Buckets that have ended: edges of those within most, the rows of the others."""
        big = np.flatnonzero(np.diff(cuts) > most)
        for k in big:
            at = slice(cuts[k], cuts[k + 1])
            yield rows(cols[4][at], cols[4][at], cols[0][at], cols[1][at])
        if len(big):
            keep = np.ones(len(cols[0]), bool)
            for k in big:
                keep[cuts[k] : cuts[k + 1]] = False
            size = np.delete(np.diff(cuts), big)
            cols, cuts = [c[keep] for c in cols], np.concatenate([[0], np.cumsum(size)])
        if len(cols[0]):
            yield edges(cols, cuts)

    return run


def links(fps: DataFrame, max_bits: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(src, dst): edges that join the same fingerprints as all pairs within max_bits do. fps: distinct, column fp."""
    keyed = fps.select("fp", F.explode(ring_keys(F.col("fp"), max_bits)).alias("k")).select("k.tab", "k.key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")
    by = ["tab", "key", "lo", "hi"]
    schema = "tab int, key long, src long, dst long"
    found = save(keyed.repartition("tab", "key").sortWithinPartitions(*by).mapInArrow(_bucket_edges(max_bits, max_bucket), schema), "edges")
    edges = found.where("tab < 0").select("src", "dst")
    large = found.where("tab >= 0").select("tab", "key", F.col("src").alias("fp"))
    sizes = large.groupBy("tab", "key").agg(F.ceil(F.count("*") * 2 / F.lit(max_bucket)).cast("int").alias("blocks"))
    if sizes.isEmpty():
        return edges
    # A large bucket is cut into blocks by a hash of the fingerprint, and every pair of blocks is a bucket of its own.
    block = large.join(sizes, ["tab", "key"]).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(5)), "blocks").cast("int"))
    pairs = block.select("tab", "key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    blocks = pairs.select("tab", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    more = blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(_bucket_edges(max_bits, 1 << 40), schema)
    return edges.unionByName(save(more, "edges-large").select("src", "dst"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component of the edges (src, dst), by large and small stars."""
    now = save(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "stars")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = save(small, "stars")
        got = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_saved(now)
        now = new
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of docs: id, fp, component (the smallest id that links reach, its own included).

    A null id keeps its row and never is a smallest id, unless its whole component has none: then component is null.
    Repeated rows each keep a row. Texts without words share fingerprint 0, which links like any other. An empty
    table gives an empty result.
    """
    marked = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = save(marked.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")
