"""What the training-data operators share: tokens, shared storage, small expression helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Bits of a sieve for each of its rows, places that a row sets, and the most bits of a sieve (16 MB).
ROW_BITS, PLACES, MAX_BITS = 12, 4, 1 << 27


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once even where body reads it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(taken: list[str], name: str) -> str:
    """name with underscores behind it until no column of taken has it; Spark's names ignore case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def whole(columns: list[str]) -> Column:
    """The columns as one struct ``doc``: beside it an operator's own names can not clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc")


def parts(columns: list[str], of: str = "doc") -> list[Column]:
    """The columns back out of ``doc``."""
    return [F.col(f"{of}.`{c}`").alias(c) for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir. Where that is unset, a temporary
    folder will do on one machine, and on a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places (PLACES, rows) of 64-bit hashes in so many bits, a power of two."""
    return np.stack([(hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(65 - bits.bit_length()) for k in range(PLACES)])


def _words(bits: int):
    """Rows (hash); gives (word, set): the bits that a batch sets, 64 a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(0).to_numpy(), bits))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (word, held)], ["word", "set"])

    return run


def sieve(rows: DataFrame, max_bits: int = MAX_BITS) -> Callable[[Column], Column]:
    """A test for 64-bit hashes: true for those in rows, one column without nulls, and for about one in a hundred others.

    It is a Bloom filter, sent to all tasks: rows that a join would drop need not move for it. What it lets pass is still
    to be joined. Where rows ask for more than max_bits, a power of two, more and more others pass.
    """
    bits = max(1 << 10, min(max_bits, 1 << (ROW_BITS * rows.count()).bit_length()))
    got = rows.mapInArrow(_words(bits), "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[got["word"].to_numpy()] = got["set"].to_numpy().view(np.uint64)

    @F.pandas_udf("boolean")
    def passes(hashes: pd.Series) -> pd.Series:
        at = _places(hashes.to_numpy(), bits)
        return pd.Series(((held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0))

    return passes
