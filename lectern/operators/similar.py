"""Pairs of vectors at or over a cosine, exactly, without holding every vector against every other where angles rule it out.

Angles obey the triangle inequality: two vectors within an angle of each other differ by no more than that in their angles
to any pivot. Vectors live in the cell of their nearest pivot; a cell is known by the smallest and largest angles of its
vectors to all pivots, and only vectors that lie within the threshold of these bounds visit it. Cells, however large, are cut
into blocks, and those that visit a cell into parts; a task holds one block while one part streams by. A pair meets once, so
pairs are not dealt out again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots, vectors of one block, vectors of one part of those that visit it, and scores that a task holds at once.
PIVOTS, BLOCK, PART, SCORES = 32, 16_384, 65_536, 1 << 22
#: What bounds and scores may lose to rounding.
_SLACK = 1e-6
#: key is that of a row that is held, seeker that of one that visits.
_ROW = ("group", "key", "seeker", "vector")


def _unit(column: pa.Array, size: int) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    n = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(n == 0, 1, n)


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def _bounds(pivots: np.ndarray):
    """(cell, pivot, low, high) of a task's vectors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pivots)
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for b in batches:
            a = _angles(_unit(b.column("vector"), pivots.shape[1]), pivots)
            np.minimum.at(low, a.argmin(axis=1), a)
            np.maximum.at(high, a.argmin(axis=1), a)
        cell, pivot = np.nonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(pivot.astype(np.int32)), pa.array(low[cell, pivot]), pa.array(high[cell, pivot])], ["cell", "pivot", "low", "high"])

    return rows


def _dealt(pivots: np.ndarray, low: np.ndarray, high: np.ndarray, angle: float, holds: bool, seeks: bool, itself: bool):
    """Rows (group, key, seeker, vector) with the cells they are held in or visit; ``marked`` of it tells besides which ones
    visit the cell that holds them (inner)."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = _angles(_unit(b.column("vector"), pivots.shape[1]), pivots)
            home = a.argmin(axis=1)
            pick, cell, held, inner = [], [], [], []
            if holds:
                pick, cell, held, inner = [np.arange(len(home))], [home], [np.ones(len(home), bool)], [np.zeros(len(home), bool)]
            if seeks:
                near = ((a[:, None, :] >= low - angle - _SLACK) & (a[:, None, :] <= high + angle + _SLACK)).all(axis=2)
                if itself:
                    # Each pair of cells meets in the later one.
                    near &= np.arange(len(pivots)) >= home[:, None]
                r, c = np.nonzero(near)
                pick, cell, held, inner = [*pick, r], [*cell, c], [*held, np.zeros(len(r), bool)], [*inner, (home[r] == c) & itself]
            at = pa.array(np.concatenate(pick))
            more = [pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(held)), pa.array(np.concatenate(inner))]
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in _ROW] + more, [*_ROW, "cell", "held", "inner"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in marked(batches):
            yield b.drop_columns(["inner"])

    rows.marked = marked
    return rows


def _met(threshold: float):
    """Pairs of a sorted partition: a block's held rows come first, then those that visit it. Rows of the block itself
    (twin) meet the held ones of a larger tag only, so no pair comes twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, keys, mine, tags = None, [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            size, n = len(b.column("vector")[0]), b.num_rows
            marks = [b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "part", "held", "twin")]
            new = np.any([m[1:] != m[:-1] for m in marks], axis=0)
            group = b.column("group")
            new |= pc.fill_null(pc.not_equal(group.slice(1), group.slice(0, n - 1)), True).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [n]])
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part, (*block, held, twin) = b.slice(start, end - start), (group[start].as_py(), *(m[start] for m in marks))
                u, own, tag = _unit(part.column("vector"), size), part.column("key" if held else "seeker"), part.column("tag").to_numpy()
                if block != of:
                    of, keys, mine, tags = block, [], [], []
                if held:
                    keys, mine, tags = [*keys, own], [*mine, u], [*tags, tag]
                    continue
                if not keys:
                    continue
                # The block is put together once.
                if len(keys) > 1:
                    keys, mine, tags = [pa.concat_arrays(keys)], [np.concatenate(mine)], [np.concatenate(tags)]
                step = max(1, SCORES // len(mine[0]))
                for k in range(0, len(u), step):
                    score = u[k : k + step] @ mine[0].T
                    i, j = np.nonzero(score >= threshold)
                    if twin:
                        mark, other = tag[i + k], tags[0][j]
                        good = mark < other
                        for x in np.flatnonzero(mark == other).tolist():
                            good[x] = repr(own[int(i[x]) + k].as_py()) < repr(keys[0][int(j[x])].as_py())
                        i, j = i[good], j[good]
                    a, c = own.take(pa.array(i + k)), keys[0].take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([pa.array([block[0]] * len(i), group.type), a, c, pa.array(score[i, j])], ["group", "a", "b", "score"])

    return rows


def similar_pairs(left: DataFrame, right: DataFrame | None, threshold: float, pivots: int = PIVOTS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(group, a, b, score): pairs of keys of left and right, of one group, whose cosine is at or over the threshold.

    Both hold group, key (of any sortable type) and vector (of one length). Without right, pairs are of left with itself,
    each once and never of one key, the smaller key first. Null vectors have no pairs; a zero vector has cosine 0.
    """
    angle, itself = float(np.arccos(np.clip(threshold, -1.0, 1.0))), right is None
    kind = dict(left.dtypes)["key"], dict((left if itself else right).dtypes)["key"]
    null = lambda k: F.lit(None).cast(kind[k])
    left = left.where(F.col("vector").isNotNull()).select("group", (F.col("key") if itself else null(1)).alias("key"), F.col("key").alias("seeker"), "vector")
    kept = left if itself else right.where(F.col("vector").isNotNull()).select("group", "key", null(0).alias("seeker"), "vector")
    kinds = dict(kept.dtypes)
    # A group within a block needs no cells.
    sizes = kept.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    chosen = kept.join(sizes.where("blocks > 1").select("group"), "group", "left_semi").orderBy(F.xxhash64("key")).limit(pivots).select("vector").collect()
    row = f"group {kinds['group']}, key {kind[1]}, seeker {kind[0]}, vector {kinds['vector']}, cell int, held boolean, inner boolean"
    if chosen:
        p = np.array([r[0] for r in chosen], float)
        p = p / np.where((n := np.linalg.norm(p, axis=1, keepdims=True)) == 0, 1, n)
        k = len(p)
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        found = kept.mapInArrow(_bounds(p), "cell int, pivot int, low double, high double").groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        for r in found.collect():
            low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"], r["high"]
        home = kept.mapInArrow(_dealt(p, low, high, angle, True, itself, itself).marked, row)
        dealt = home if itself else home.unionByName(left.mapInArrow(_dealt(p, low, high, angle, False, True, False).marked, row))
    else:
        there = lambda df, held, inner: df.select("*", F.lit(0).alias("cell"), F.lit(held).alias("held"), F.lit(inner).alias("inner"))
        dealt = there(kept, True, False).unionByName(there(left, False, itself))
    # Blocks of a cell and parts of its visitors, each of which meets each.
    cut = lambda rows, size: F.greatest(F.lit(1), F.ceil(F.count_if(rows) / size)).cast("int")
    counted = dealt.groupBy("group", "cell").agg(cut(F.col("held"), block).alias("blocks"), cut(~F.col("held"), part).alias("parts"))
    tag, whole = F.xxhash64("key", "seeker"), lambda n: F.sequence(F.lit(0), n - 1)
    placed = dealt.join(counted, ["group", "cell"]).withColumns({"tag": tag, "own": F.pmod(tag, F.col("blocks")).cast("int"), "share": F.pmod(F.xxhash64(tag), F.col("parts")).cast("int")})
    # Of two blocks of a cell, the earlier one's rows visit the later one.
    visits = F.when(F.col("inner"), F.sequence("own", F.col("blocks") - 1)).otherwise(whole(F.col("blocks")))
    placed = placed.withColumn("block", F.explode(F.when(F.col("held"), F.array("own")).otherwise(visits)))
    placed = placed.withColumn("part", F.explode(F.when(F.col("held"), whole(F.col("parts"))).otherwise(F.array("share")))).withColumn("twin", F.col("inner") & (F.col("block") == F.col("own")))
    tile = ["group", "cell", "block", "part"]
    sorted_ = placed.repartition(*tile).sortWithinPartitions(*tile, F.desc("held")).select(*_ROW, "cell", "block", "part", "held", "twin", "tag")
    met = sorted_.mapInArrow(_met(threshold), f"group {kinds['group']}, a {kind[0]}, b {kind[1]}, score double")
    if not itself:
        return met
    met = met.where("a <> b").select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    # Only rows of one key make a pair more than once.
    if kept.groupBy("group", "key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return met
    return met.groupBy("group", "a", "b").agg(F.max("score").alias("score"))
