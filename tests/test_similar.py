"""Cosine joins by pivots and linkage in rounds, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import joins, similar, voices


def clustered(n, dim=16, kinds=8, noise=0.25, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(kinds, dim))
    return [(base[k % kinds] + noise * rng.normal(size=dim)).tolist() for k in range(n)]


def cosines(x, y):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    return unit(np.array(x, float)) @ unit(np.array(y, float)).T


@pytest.mark.parametrize("block,threshold", [(10_000, 0.7), (16, 0.7), (16, 0.2), (7, 0.95)])
def test_pairs_equal_all_pairs(spark, block, threshold):
    vectors = [*clustered(150), [0.0] * 16]
    df = spark.createDataFrame([(k % 2, k, v) for k, v in enumerate(vectors)], "group int, key long, vector array<double>").repartition(5)
    got = {(r.a, r.b): r.score for r in similar.similar_pairs(df, None, threshold, pivots=6, block=block).collect()}
    c = cosines(vectors, vectors)
    want = {(i, j) for i in range(151) for j in range(i + 1, 151) if i % 2 == j % 2 and c[i, j] >= threshold}
    assert set(got) == want and all(abs(v - c[k]) < 1e-9 for k, v in got.items())
    other = df.where("key % 3 = 0")
    met = {(r.a, r.b) for r in similar.similar_pairs(df, other, threshold, pivots=6, block=block).collect()}
    assert met == {(i, j) for i in range(151) for j in range(0, 151, 3) if i % 2 == j % 2 and c[i, j] >= threshold}
    assert similar.similar_pairs(df.limit(0), None, threshold).count() == 0


def test_angles_rule_most_pairs_out(spark, monkeypatch):
    n, compared = 1200, []
    vectors = clustered(n, dim=32, kinds=40, noise=0.12, seed=3)
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(vectors)], "group int, key long, vector array<double>")
    plain = similar._dealt

    def counted(*how):
        run = plain(*how)
        rows = df.select("group", "key", F.col("key").alias("seeker"), "vector").mapInArrow(run, "group int, key long, seeker long, vector array<double>, cell int, held boolean").groupBy("cell").agg(F.sum(F.col("held").cast("int")).alias("h"), F.sum((~F.col("held")).cast("int")).alias("v"))
        compared.append(sum(r.h * r.v for r in rows.collect()))
        return run

    monkeypatch.setattr(similar, "_dealt", counted)
    got = similar.similar_pairs(df, None, 0.9, pivots=40, block=100).count()
    assert got == int((np.triu(cosines(vectors, vectors), 1) >= 0.9).sum()) > 1000
    assert compared[0] < 0.15 * n * n, f"share of compared pairs {compared[0] / n / n:.3f}"


def test_matches_have_no_cross_join(spark):
    prints = spark.createDataFrame([(k % 4, f"S{k}", v) for k, v in enumerate(clustered(60))], "session_id long, code string, centroid array<double>")
    known = spark.createDataFrame([(f"N{k % 8}", v) for k, v in enumerate(clustered(24, seed=1))], "name string, centroid array<double>")
    got = joins.match_voice(prints, known, 0.8, 0.05)
    c = cosines([r.centroid for r in prints.collect()], [r.centroid for r in known.collect()])
    want = {}
    for k, row in enumerate(c):
        best = sorted(((max(row[j] for j in range(24) if j % 8 == n), f"N{n}") for n in range(8)), key=lambda x: (-x[0], x[1]))
        if best[0][0] >= 0.8 and best[0][0] - best[1][0] >= 0.05:
            want[f"S{k}"] = best[0][1]
    assert {r.code: r.name for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rounds_equal_chains(spark):
    rows = [(s, 1000 * s + k, v) for s, n in ((1, 40), (2, 20), (3, 5)) for k, v in enumerate(clustered(n, dim=8, kinds=4, noise=0.6, seed=s))]
    df = spark.createDataFrame(rows, "session_id long, item long, centroid array<double>")
    chains = {(r.session_id, r.item): r.label for r in voices.cluster_voices(df, 0.5).collect()}
    rounds = {(r.session_id, r.item): r.label for r in voices.cluster_voices(df, 0.5, one_task=3).collect()}
    assert rounds == chains and len(chains) == 65 and len(set(chains.values())) > 6
