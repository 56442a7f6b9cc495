"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_list, hmm, mixing, packing, pii, ppm, prefix_trie, resampling, sentence_spans, simhash, tiling, warc, weak_labels
from .common import save, table


def fold_of(id_col: str, folds: int = 5):
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = save(decision_list.statistics(table(spark, sf_dir, "documents"), keep=["doc_id"]), "statistics")
    kept, _ = decision_list.verdict(decision_list.learn_rules(stats, table(spark, sf_dir, "labels")))
    return stats.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.pivotal_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.repeated_spans(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    chars = F.aggregate("removed", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", F.get("first_ids", F.lit(0)).alias("first_doc_id"), F.size("removed").alias("n_spans"), chars.alias("removed_chars"), spans.alias("spans"))


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item_tokens", "matched_tokens", "n_tiles", "coverage")


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir, "documents"))


def op10_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda c: c["base"])
    of = lambda k: lambda c: c["base"] & (c["kind"] == k)
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), F.coalesce(fold_of("doc_id") != 1, F.lit(True)))


def op2_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of("doc_id") == 0
    model = ppm.train(docs.where(~F.coalesce(held, F.lit(False))))
    return ppm.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_hmm": op1_hmm,
    "op3_pivotal_mixing": op3_pivotal_mixing,
    "op2_warc_merge": op2_warc_merge,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_string_tiling": op5_string_tiling,
    "op6_ppm_language": op6_ppm_language,
    "op7_simhash": op7_simhash,
    "op9_weak_labels": op9_weak_labels,
    "op10_pii_votes": op10_pii_votes,
    "op8_decision_list": op8_decision_list,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_merge": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    # crc32 by the table of its 256 remainders; a node is a list of turns.
    "op11_prefix_trie": """
        WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) AS r(i))),
        own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
                FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        cut AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
                       lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h FROM own, tab),
        made AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
                 FROM cut AS c LEFT JOIN own AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
        member AS (SELECT conv_id, turns, d, turns[1:d] AS node FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM made)),
        nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = d), '') AS ends
                  FROM member GROUP BY node, d),
        kids AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
        worth AS (SELECT x.*, coalesce(k.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(x.node[d].t) END AS saved FROM nodes AS x LEFT JOIN kids AS k ON k.node = x.node),
        sums AS (SELECT node[1:e] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM worth) GROUP BY 1)
        SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
        FROM worth AS w JOIN sums AS s ON s.node = w.node LEFT JOIN nodes AS p ON w.d > 0 AND p.node = w.node[1:w.d - 1]""",
}
