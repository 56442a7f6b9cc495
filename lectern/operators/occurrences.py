"""Which of many terms occur in which texts, without holding every text against every term.

A list in bounds is cut into slices; a task builds an Aho-Corasick automaton of one slice and streams its texts through it.
A longer list meets the texts on grams: each term waits at its rarest run of three characters, texts come with theirs, and
only pairs that share that run are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms and characters of a slice, slices at most, and the length of a gram.
SLICE_TERMS, SLICE_CHARS, SLICES, GRAM = 100_000, 4_000_000, 8, 3


def _found(terms: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        tree = Automaton()
        for t in terms:
            tree.add_word(t, t)
        tree.make_automaton()
        for b in batches:
            texts, hits = [], []
            for text in b.column(0).to_pylist():
                own = {t for _, t in tree.iter(text)}
                texts += [text] * len(own)
                hits += own
            yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "term": pa.array(hits, pa.string())})

    return rows


def _grams(text: Column, size: Column | int) -> Column:
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size if isinstance(size, Column) else F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _by_grams(texts: DataFrame, terms: DataFrame) -> DataFrame:
    sizes = [r[0] for r in terms.select(F.least(F.length("term"), F.lit(GRAM))).distinct().collect()]
    own = terms.select("term", F.explode(_grams(F.col("term"), F.least(F.length("term"), F.lit(GRAM)))).alias("gram"))
    asked = own.select("gram").distinct()
    said = None
    for size in sizes:
        some = texts.select("text", F.explode(_grams(F.col("text"), size)).alias("gram"))
        said = some if said is None else said.unionByName(some)
    said = said.join(asked, "gram", "left_semi")
    # A term with a gram that no text has gets no anchor: it occurs nowhere.
    counted = own.join(said.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    anchors = counted.groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return said.join(anchors, "gram").where(F.contains("text", "term")).select("text", "term")


def occurrences(texts: DataFrame, terms: DataFrame, slice_terms: int = SLICE_TERMS, slices: int = SLICES) -> DataFrame:
    """(text, term), each pair once: the terms of ``terms`` (term) that a text of ``texts`` (text) contains.

    Nulls and empty terms never occur; equal texts and equal terms count once. No terms or no texts give an empty result.
    """
    texts = texts.where(F.col("text").isNotNull()).select("text").distinct()
    terms = terms.where(F.col("term") != "").select("term").distinct()
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return _by_grams(texts, terms) if not terms.isEmpty() else texts.limit(0).withColumn("term", F.lit(""))
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    need = max(-(-n // slice_terms), -(-chars // SLICE_CHARS))
    if need > slices:
        return _by_grams(texts, terms)
    out = None
    for k in range(max(1, need)):
        # A slice holds its share of the terms, so its size is bounded.
        own = [r[0] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(max(1, need))) == k).collect()]
        found = texts.mapInArrow(_found(own), "text string, term string") if own else texts.limit(0).withColumn("term", F.lit(""))
        out = found if out is None else out.unionByName(found)
    return out
