"""Helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most ``most`` rows; as it is beyond that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_buckets(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """One row for each time bucket that [start, end] touches, numbered in _b."""
    low, high = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width)
    return df.withColumn("_b", F.explode(F.sequence(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """Pairs of one key whose spans (start, end_time) and (r_start, r_end) overlap, each once, with ``overlap``.

    Both sides are cut into time buckets, so a pair meets in an equi-join on key and bucket; a pair that shares
    several buckets counts in the first of them.
    """
    a, b = with_buckets(left, "start", "end_time", width), with_buckets(right, "r_start", "r_end", width)
    first = F.floor(F.greatest("start", "r_start") / width)
    joined = a.join(b, [*keys, "_b"]).where((F.col("_b") == first) & (F.least("end_time", "r_end") > F.greatest("start", "r_start")))
    return joined.drop("_b").withColumn("overlap", F.least("end_time", "r_end") - F.greatest("start", "r_start"))


def in_cells(spans: DataFrame, turns: DataFrame, run: Callable, schema: str, width: float = 60.0) -> DataFrame:
    """What run gives for the spans (session_id, id, who, start, end_time) of a cell and the turns (session_id, who, start,
    end_time) that overlap or lie in one of them; no column is null.

    A cell is the spans of one session that start in one stretch of time. A task holds the turns of one cell while its spans
    stream by, so there is no row for a span and a turn. run takes the turns' who, start and end_time, sorted by start and
    who, and the spans as a batch, and gives a batch.
    """
    own = spans.withColumn("cell", F.floor(F.col("start") / width))
    hulls = own.groupBy("session_id", "cell").agg(F.min("start").alias("low"), F.max(F.greatest("start", "end_time")).alias("high"))
    met = with_buckets(hulls, "low", "high", width).join(with_buckets(turns, "start", "end_time", width), ["session_id", "_b"])
    first = F.floor(F.greatest("low", "start") / width)
    met = met.where((F.col("_b") == first) & (F.col("start") < F.col("high")) & (F.col("end_time") > F.col("low")))
    cols = ["session_id", "cell", "is_span", "id", "who", "start", "end_time"]
    none = F.lit(None).cast(spans.schema["id"].dataType)
    rows = met.withColumns({"is_span": F.lit(False), "id": none}).select(*cols).unionByName(own.withColumn("is_span", F.lit(True)).select(*cols))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, turns_, held = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            session, cell, is_span = b.column("session_id"), b.column("cell").to_numpy(), b.column("is_span").to_numpy(zero_copy_only=False)
            names = session.dictionary_encode().indices.to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]) | (cell[1:] != cell[:-1]) | (is_span[1:] != is_span[:-1])) + 1, [b.num_rows]]).tolist()
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                part, now = b.slice(start, end - start), (session[start].as_py(), cell[start])
                if now != of:
                    of, turns_, held = now, [], None
                if not is_span[start]:
                    turns_.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("who", "start", "end_time")])
                    continue
                if held is None:
                    held = [np.concatenate(c) for c in zip(*turns_, strict=True)] if turns_ else [np.empty(0)] * 3
                yield run(*held, part)

    return rows.repartition("session_id", "cell").sortWithinPartitions("session_id", "cell", "is_span", "start", "who").mapInArrow(cells, schema)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df through the checkpoint folder of the session; a temporary one only where none is set."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach. Labels spread to neighbours and then jump to their own label's label."""
    both = cut_lineage(edges.union(edges.select("b", "a")).distinct())
    now = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("_n"))
        spread = now.join(near, now["node"] == near["a"], "left").select("node", F.least("root", "_n").alias("root"), F.col("root").alias("_old"))
        jump = spread.select(F.col("node").alias("_j"), F.col("root").alias("_r"))
        new = cut_lineage(spread.join(jump, spread["root"] == jump["_j"], "left").select("node", F.least("root", "_r").alias("root"), "_old"))
        changed = new.where(F.col("root") != F.col("_old")).limit(1).count()
        now = new.drop("_old")
        if not changed:
            return now
    raise RuntimeError("components did not settle")
