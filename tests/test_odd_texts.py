"""Queries against their SQL on texts that the given tables have few of."""

from collections import Counter

import duckdb
import pytest

from lectern.functions import text as T
from lectern.plans import registry

registry.load()

TEXTS = ["", "a", "abc", "stra\u00dfe und gru\u00df", "\ufb01sch \u0149 \u01f0 \u1f80 \u1fb3 \u1fbc \u0390 \u1e96", "\U00010428 \U0001f600\U0001f601 x", "\u0131i\u0130I \u01c6 \u01c5", "one two\nthree. ", "abcd" * 40, "xabcd" * 300]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(c, t, "user" if t % 2 else "assistant", TEXTS[(c + t) % len(TEXTS)]) for c in range(12) for t in range(10)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(1, 0, [1.0, 0.0])], "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["top3_top_changes", "edt3_replace_transcript"])
def test_agrees_with_sql(name, spark, odd):
    path, con = odd
    df = registry.QUERIES[name](spark, path)
    cur = con.execute(registry.ORACLE_SQL[name])
    assert [d[0] for d in cur.description] == df.columns
    assert Counter(map(tuple, df.collect())) == Counter(cur.fetchall())


def test_top_changes_counts_every_place_of_whole_texts(spark, odd):
    path, con = odd
    want = Counter()
    for c, source in con.execute("SELECT conv_id % 3, concat(regexp_replace(replace(text, chr(10), ' '), '[. ]+$', ''), CASE WHEN turn % 3 = 2 THEN '.' ELSE '' END) FROM conversations").fetchall():
        want.update((("zh", "vi", "en")[c], source[i : i + 3], source[i + 3 : i + 4]) for i in range(max(1, len(source))))
    best = {x: sorted(((-n, k[1], k[2]) for k, n in want.items() if k[0] == x))[:10] for x in ("zh", "vi", "en")}
    got = registry.QUERIES["top3_top_changes"](spark, path).collect()
    assert sorted((r["class"], -r.n, r.was, r.now) for r in got) == sorted((x, *b) for x, rows in best.items() for b in rows)


def test_upper_by_character_is_duckdb_upper(spark):
    every = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000], "id long, c string")
    got = {r.id: r.u for r in every.select("id", T.upper_by_character(F.col("c")).alias("u")).collect()}
    rows = duckdb.connect().execute("SELECT i, upper(chr(CAST(i AS INT))) FROM range(1, 131072) t(i) WHERE i < 55296 OR i > 57343").fetchall()
    assert [(hex(i), u, got[i]) for i, u in rows if got[i] != u] == []
