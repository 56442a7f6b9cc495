"""What the pipeline's stages write and move of the texts, and that sieves lose no row."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lectern.llm import common, decision_list, mixing, shingle_pairs

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _moved(spark):
    """Bytes of all shuffles so far."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def _docs(spark, tmp_path, n, words):
    rng = random.Random(8)
    rows = [(d, " ".join(f"{rng.randrange(1 << 60):x}" for _ in range(words)), "en", "ab"[d % 2], 1) for d in range(n)]
    spark.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs")), sum(len(r[1]) for r in rows) / 2  # a digit is half a byte


def test_texts_without_a_partner_stay_where_they_are(spark, tmp_path, sf_dir, no_broadcast):
    # Half of the small hashes would be 0.14 of a text's size; whole texts were moved twice.
    docs, size = _docs(spark, tmp_path, 40, 4000)
    before = _moved(spark)
    assert pipeline.near_duplicates(spark, docs, sf_dir).agg(F.sum(F.length("text"))).first()[0] > size
    assert _moved(spark) - before < size


def test_mix_moves_texts_once(spark, tmp_path, no_broadcast):
    docs, size = _docs(spark, tmp_path, 200, 400)
    before = _moved(spark)
    mixing.mixture(docs).write.parquet(str(tmp_path / "mix"))
    assert _moved(spark) - before < 2 * size


def test_mix_deals_null_ids_and_sources(spark):
    text = "one two three"
    rows = [(None, text, "en", None, 1), (None, text + " four", "en", None, 1), (None, None, "en", None, None), (1, text, "en", None, 1), (None, text, "en", "a", 1), (None, text, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SHAPE)
    by = ["doc_id", "source", "size", "copies"]
    copies = mixing.pivotal_copies(docs).where("copies > 0").select(*by)
    assert sorted(mixing.mixture(docs).select(*by).collect(), key=str) == sorted(copies.collect(), key=str) != []


def test_quality_rules_write_no_copy_of_the_texts(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    folder = common.shared_dir(spark).removeprefix("file:")
    old = set(os.listdir(folder))
    kept = decision_list.kept_rows(docs, labels).select("doc_id").collect()
    judged = decision_list.judge(docs, labels).where("kept").select("doc_id").collect()
    assert sorted(kept) == sorted(judged) and 0 < len(kept) < docs.count()
    for made in set(os.listdir(folder)) - old:
        assert "text" not in spark.read.parquet(f"{folder}/{made}").schema.simpleString()


def test_sieve_passes_its_rows_and_few_others(spark):
    rows, others = (spark.range(a, a + n).select(F.xxhash64("id").alias("h")) for a, n in ((0, 3000), (10**6, 20000)))
    passes = common.sieve(rows)
    assert rows.where(passes(F.col("h"))).count() == 3000
    assert others.where(passes(F.col("h"))).count() < 400
    assert others.where(common.sieve(rows.limit(0))(F.col("h"))).count() == 0
    # Beyond its bound it lets others pass, and still all of its own.
    full = common.sieve(rows, max_bits=1024)
    assert rows.where(full(F.col("h"))).count() == 3000 and others.where(full(F.col("h"))).count() > 19000


def test_near_duplicates_keep_the_same_rows_without_a_sieve(spark, sf_dir, monkeypatch):
    rows = [(1, "a b c d e f", "en", "z", 1), (1, "a b c d e f", "en", "y", 1), (2, "A B c d e f", "en", "a", 1), (None, "q r s t u v", None, None, None), (None, "q r s t u v", None, None, None), (4, None, "en", "a", 1), (3, "", "en", "a", 1), (5, "k l m n o p q", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SHAPE)
    want = [(1, "y"), (3, "a"), (5, "a"), (None, None)]
    for through in (False, True):
        if through:
            for module in (pipeline, shingle_pairs):
                monkeypatch.setattr(module, "sieve", lambda rows: lambda hashes: F.lit(True))
        got = [(r.doc_id, r.source) for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
