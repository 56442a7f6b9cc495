"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same wanted number of copies, target / source size: a whole part and a fraction.
The fractions are rounded in pairs: mass moves between two documents, weighted by their sizes so that the expected
words stay the same, until one of the two is whole. What is left of a block of documents is at most one fraction;
blocks are combined in a tree, so no task sees more than one block's rows, however large the source. The last fraction of a
source may belong to a large document; what rounding it leaves of the target is then made up by whole copies of documents
shorter than twice of what is missing, until a thousandth is missed at most or none is left that short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_saved, fresh, parts, save, whole

#: Rows of one block, in expectation, and blocks combined into one at each level of the tree.
BLOCK = 8192
#: Shares of what a source misses that its short documents are drawn in, and how many of these shares are looked at.
SHARES, LOOKED_AT = 64, 256
#: The part of a target that may be missed.
NEAR = 0.001


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target) from (source, size) of every source: few rows, so plain numbers on the driver.

    Weights repeat over the sources in code point order, null last. What exceeds cap times a source's size goes to
    the sources not yet capped, by weight, until none is above. If all are capped the excess is lost.
    """
    # UTF-8 bytes order as code points do.
    got = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    total = sum(s for _, s in got)
    open_, target, left = list(range(len(got))), [0.0] * len(got), float(total)
    while open_ and left > 0:
        per = left / sum(weights[k % len(weights)] for k in open_)
        over = [k for k in open_ if weights[k % len(weights)] * per > cap * got[k][1]]
        if not over:
            for k in open_:
                target[k] = weights[k % len(weights)] * per
            break
        for k in over:
            target[k] = cap * got[k][1]
            left -= target[k]
            open_.remove(k)
    return [(s, n, t) for (s, n), t in zip(got, target, strict=True)]


def _pivot(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The parts after pairing along the rows: all 0 or 1, but for one at most."""
    out, hold = part.copy(), -1
    for k in range(len(size)):
        if not 0.0 < out[k] < 1.0:
            continue
        if hold < 0:
            hold = k
            continue
        a, b, p, q = float(size[hold]), float(size[k]), out[hold], out[k]
        up, down = min(1.0 - p, q * b / a), min(p, (1.0 - q) * b / a)
        if draw[k] * (up + down) < down:
            p, q = p + up, q - up * a / b
        else:
            p, q = p - down, q + down * a / b
        # Rounding errors must not keep a whole number fractional.
        p, q = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (p, q))
        out[hold], out[k] = p, q
        if 0.0 < q < 1.0:
            hold = k
        elif not 0.0 < p < 1.0:
            hold = -1
    return out


def _round_blocks(seed: int):
    """Rounds runs of equal (source, at) in a sorted partition, one run in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, size = t["row"].to_numpy(), t["size"].to_numpy()
            # A draw belongs to its row and level, so a rerun of any task gives the same.
            mixed = (ids.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            draw = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53
            part = _pivot(size, t["part"].to_numpy(), draw)
            return t.set_column(5, "part", pa.array(part)).to_batches()[0]

        key = None
        for b in batches:
            start = 0
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for k in range(len(keys) + 1):
                if k == len(keys) or keys[k] != key:
                    if k > start:
                        held.append(b.slice(start, k - start))
                    if k < len(keys):
                        if held:
                            yield settle()
                            held.clear()
                        key, start = keys[k], k
        if held:
            yield settle()

    return run


def pivotal_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 0) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies.

    A null text has size 0; size 0 takes no part in the rounding and gets the whole part of its wanted copies. A
    null source is a source of its own. Repeated rows are rounded one by one. Rows with the same id and size are
    interchangeable, so a rerun gives each of them the same set of copies. An empty table gives an empty result.
    """
    sized = save(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), text_size(F.col(f"`{text_col}`")).alias("size")), "sizes")
    spark = docs.sparkSession
    # One row per source of the corpus; sources are labels, a list that people keep.
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    counts = {r["source"]: r["n"] for r in rows}
    found = source_targets([(r["source"], r["source_size"]) for r in rows], weights, cap)
    plan = spark.createDataFrame(
        [(s, n, t, int(t // n) if n else 0, (t / n) % 1.0 if n else 0.0, max(1, -(-counts[s] // BLOCK))) for s, n, t in found],
        "source string, source_size long, target double, whole long, part double, blocks long",
    )
    wide = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"])).select("id", sized["source"], "size", "source_size", "target", "whole", "part", "blocks")
    # Rows of one id differ by size only; equal rows get numbers of their own where it matters, in their block.
    keyed = wide.withColumn("row", F.xxhash64("id", "size"))
    whole = keyed.where("size = 0 OR part = 0").select("id", "source", "size", "source_size", "target", F.when(F.col("size") == 0, F.least("whole", F.lit(1))).otherwise(F.col("whole")).alias("copies"))
    level = keyed.where("size > 0 AND part > 0").select("id", "source", F.pmod(F.xxhash64("row", F.lit(seed)), "blocks").alias("at"), "row", "size", "source_size", "target", "whole", "part")
    extra = ["id", "source_size", "target"]
    settled, blocks, depth = [], max([1, *(-(-n // BLOCK) for n in counts.values())]), 0
    while True:
        ordered = level.repartition("source", "at").sortWithinPartitions("source", "at", F.desc("size"), "row")
        # Large documents first, so that the fraction that is left more often belongs to a small one.
        shaped = ordered.select("source", "at", "row", "size", "whole", "part", *extra)
        schema = shaped.schema
        done = save(shaped.mapInArrow(_round_blocks(seed * 131 + depth), schema), f"mix-{depth}")
        last = blocks <= 1
        final = F.col("part").isin(0.0, 1.0) if not last else F.lit(True)
        # The last fraction of a source is rounded by a draw of its own.
        draw = F.pmod(F.xxhash64("row", F.lit(seed + 7)), F.lit(1 << 40)) / float(1 << 40)
        part = F.when(F.col("part").isin(0.0, 1.0), F.col("part")).otherwise((draw < F.col("part")).cast("double"))
        settled.append(done.where(final).select("id", "source", "size", "source_size", "target", (F.col("whole") + part.cast("long")).alias("copies")))
        if last:
            break
        blocks, depth = -(-blocks // BLOCK), depth + 1
        level = done.where(~final).withColumn("at", F.floor(F.col("at") / BLOCK).cast("long"))
    out = whole
    for x in settled:
        out = out.unionByName(x)
    return _made_up(save(out, "mix"), cap, seed).withColumnRenamed("id", id_col)


def _made_up(out: DataFrame, cap: float, seed: int) -> DataFrame:
    """out with the words that a source's copies miss of its target, or have over it, made up by one copy more or less of
    documents that bring it nearer: those shorter than twice of what is missing.

    Each round deals a source's documents into shares of a SHARES-th of what is missing and takes the largest shares that
    bring it nearer, so what is missing shrinks many times over. It ends within NEAR of the target, or when no document
    with room is short enough.
    """
    spark, idle = out.sparkSession, 0
    by = out.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect()
    missing, near = {r["source"]: r["t"] - r["n"] for r in by}, {r["source"]: NEAR * r["t"] for r in by}
    row = F.xxhash64(F.col("o.id"), F.col("o.size"))
    while idle < 2:
        seed += 1

        def dealt(shares: dict[str | None, int], taken: dict[str | None, list[int]], now: DataFrame = out, draw: int = seed) -> DataFrame:
            plan = [(s, 1 if v > 0 else -1, abs(v), shares.get(s, 1), taken.get(s, [])) for s, v in missing.items() if abs(v) > near[s]]
            p = F.broadcast(spark.createDataFrame(plan, "source string, more long, words double, shares long, taken array<long>"))
            both = now.alias("o").join(p.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")), "left")
            fits = F.col("words").isNotNull() & (F.col("size") > 0) & (F.col("size") < 2 * F.col("words")) & (F.col("copies") + F.col("more")).between(0, int(cap))
            fits = F.coalesce(fits, F.lit(False))
            return both.select("o.*", "more", "taken", fits.alias("fits"), F.pmod(F.xxhash64(row, F.lit(draw)), F.col("shares")).alias("share"))

        held = {r["source"]: r["n"] for r in dealt({}, {}).where("fits").groupBy("source").agg(F.sum("size").alias("n")).collect()}
        if not held:
            break
        shares = {s: max(1, int(SHARES * n / abs(missing[s]))) for s, n in held.items()}
        found = dealt(shares, {}).where(F.col("fits") & (F.col("share") < LOOKED_AT)).groupBy("source", "share").agg(F.sum("size").alias("n")).collect()
        before, taken = dict(missing), {}
        for r in sorted(found, key=lambda r: (-r["n"], r["share"])):
            s = r["source"]
            if r["n"] < 2 * missing[s] * (sign := 1 if before[s] > 0 else -1):
                missing[s] -= sign * r["n"]
                taken.setdefault(s, []).append(r["share"])
        idle = 0 if taken else idle + 1
        if taken:
            after, missing = missing, before
            more = F.when(F.col("fits") & F.array_contains("taken", F.col("share")), F.col("more")).otherwise(0)
            made = save(dealt(shares, taken).withColumn("copies", F.col("copies") + more).select(*out.columns), "mix")
            drop_saved(out)
            out, missing = made, after
    return out


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs that the mix takes, with ``size``, ``copies`` and ``taken``; rows with no copy are left out.

    Rows that agree in id, source and size share their set of copies, dealt out in the order of their texts' hashes; null
    ids and sources agree with each other. A null text has size 0. An empty table gives an empty result. If docs has
    columns of the new names, those stay as they are and the new ones get an underscore.
    """
    # One column of one type, never null itself: rows are joined where they were ranked, so texts move once.
    key = F.struct("id", "source", "size")
    copies = pivotal_copies(docs, id_col, text_col, source_col, **how).select(F.col(f"`{id_col}`").alias("id"), "source", "size", "copies")
    copies = copies.select(key.alias("key"), "copies")
    dealt = copies.groupBy("key").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("all"))
    text = F.col(f"`{text_col}`")
    sized = docs.select(whole(docs.columns), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), text_size(text).alias("size"), F.xxhash64(text).alias("h"))
    ranked = sized.select("doc", key.cast(copies.schema["key"].dataType).alias("key"), "h").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("h")) - 1)
    joined = ranked.join(dealt, "key").select("doc", F.col("key.size").alias("size"), F.get("all", F.col("n")).alias("copies"))
    new = {"size": F.col("size"), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size")}
    return joined.where("copies > 0").select(*parts(docs.columns), *(c.alias(fresh(docs.columns, name)) for name, c in new.items()))
