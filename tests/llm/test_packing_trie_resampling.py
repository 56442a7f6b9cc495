"""Packing, the prefix trie and resampling against plain versions of their contracts, with odd rows and hot groups."""

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from lectern.llm import packing, prefix_trie, queries, resampling
from lectern.llm.common import table

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "alpha beta. gamma, delta " * 4000
ODD = [(1, ""), (2, None), (None, "A short text."), (3, LONG), (4, "tie " * 30), (4, "tie " * 30), (5, " \t\n\x0b\x1c\x85 "), (6, "x" * 30000), (7, "café ́  İstanbul\x00<|endoftext|>y don't 1234")]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", *(F.lit("clash").alias(c) for c in ("id", "length", "task", "place", "rank", "crc", "score", "run", "segment", "open", "name")))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


# Packing


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once_and_without_gaps(seed):
    draw = random.Random(seed)
    capacity, counts = draw.choice([7, 50, 4096]), {}
    for _ in range(draw.choice([1, 5, 200, 3000])):
        length = min(capacity, max(1, int(draw.expovariate(draw.choice([1, 3, 20]) / capacity))))
        counts[length] = counts.get(length, 0) + draw.choice([1, 2, 50])
    places, n = packing.plan(counts, capacity)
    held, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, low, high, per, seq, offset in places.tolist():
        ranks[length] += range(low, high)
        for r in range(low, high):
            held[seq + (r - low) // per].append((offset + (r - low) % per * length, length))
    assert ranks == {k: list(range(v)) for k, v in counts.items()} and sorted(held) == list(range(n))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * length > capacity for _, length in own) <= 2
    assert len(places) <= 40 * capacity
    if max(counts) * 5 < capacity:  # small pieces leave hardly anything open
        assert n <= -(-sum(k * v for k, v in counts.items()) // capacity) + 1


def test_plan_pairs_as_many_large_pieces_as_can_be():
    for seed in range(60):
        draw = random.Random(seed)
        large = [draw.randint(34, 100) for _ in range(draw.randint(1, 9))]

        def most(rest):
            if len(rest) < 2:
                return 0
            return max([most(rest[1:])] + [1 + most(rest[1:k] + rest[k + 1 :]) for k in range(1, len(rest)) if rest[0] + rest[k] <= 100])

        assert packing.plan(dict(collections.Counter(large)), 100)[1] == len(large) - most(large)


def pieces_of(rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = tokenizers.Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    out = []
    for (name, _), e in zip(rows, found, strict=True):
        ids = [*e.ids, 1]
        out += [(name, k // 4096, k, ids[k : k + 4096]) for k in range(0, len(ids), 4096)]
    return out


def check_packed(got, want):
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(((n, p, s, len(i), crc(i)) for n, p, s, i in want), key=key)
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    return len(held)


def test_packing_of_the_table_and_its_sequences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = pieces_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    used = check_packed(queries.op12_packing(spark, sf_dir).collect(), want)
    assert used <= -(-sum(len(i) for *_, i in want) // 4096) * 1.02 + 1
    whole = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)
    sent = packing.sequences(whole).collect()
    assert sorted(x for r in sent for x in r["ids"]) == sorted(x for *_, i in want for x in i) and all(r["n_tokens"] == len(r["ids"]) <= 4096 for r in sent)


def test_packing_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packed(packing.pack(odd, path).collect(), pieces_of(ODD))
    assert packing.pack(odd.limit(0), path).count() == 0


def test_a_hot_length_is_ranked_over_many_tasks(spark):
    rows = [(k, "same words here") for k in range(3000)] + [(-k, "w " * (k % 700)) for k in range(1, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    used = check_packed(packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect(), pieces_of(rows))
    assert used == -(-sum(len(i) for *_, i in pieces_of(rows)) // 4096)


# Prefix trie


def plain_trie(turns, text=len):
    """turns: conversation -> tuple of hashable turns; text: length of a turn's text."""
    members, kids = collections.defaultdict(list), collections.Counter()
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (text(p[-1]) if p else 0)
            leaves[p[:d]] += kids[p] == 0
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(turns[c]) == len(p))
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()), key=repr)


def plain_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: tuple((r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])) for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, ())[: h[c]] + own[c][h[c] :] for c in own}


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trie_of_many_small_shards_equals_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "COLUMNS", 3)
    draw = random.Random(5)
    turns = {c: tuple(draw.randint(1, 3) for _ in range(draw.choice([0, 1, 2, 5, 9, 20]))) for c in range(150)}
    turns |= {c: (1, 1, 2) for c in range(1000, 1120)}  # copies of one conversation fill several shards
    rows = [(c, [x for k in t for x in (k, 0)], list(t)) for c, t in turns.items()]
    df = spark.createDataFrame(rows, "conv_id long, ids array<long>, lens array<long>")
    for shard_rows, one_shard, least in ((16, 8, 8), (64, 40, 8), (1 << 16, 4096, 1024)):
        assert nodes(prefix_trie.trie(df, shard_rows, one_shard, least)) == plain_trie(turns, int)


def test_trie_of_odd_conversations(spark):
    rows = [
        (100, 0, "user", "hello"), (100, 1, "assistant", "hé \U0001f600"), (100, None, None, None), (101, 0, "user", "hello"), (101, 5, "user", "x" * 30000),
        (None, 0, "user", "nobody's"), (205, 0, "user", "a"), (206, 0, None, ""), (-3, 2, "user", "minus"), (-3, 1, "user", "one"), (-100, 1, "user", "base"), (300, 1, "user", "twice"), (300, 1, "user", "twice"),
    ]
    rows += [(400 + k, t, "user", f"turn {t}") for k in range(60) for t in range(7)] + [(700, t, "user", f"long {t % 11}") for t in range(300)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, ids string, n string")
    assert nodes(prefix_trie.prefix_trie(df)) == plain_trie(plain_rebuilt(rows), lambda t: len(t[1]))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


# Resampling


def plain_resampled(rows, target, percent=5):
    words = lambda t: WORD.findall((t or "").translate(FOLD))
    found = lambda t: [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for w in (words(t),) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    of = [found(t) for _, t in rows]
    s, t = collections.Counter(x for f in of for x in f), collections.Counter(x for text in target for x in found(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + 10000) / ((s[k] + 1) * (big_t + 10000)))) for k in range(10000)]
    out = []
    for (name, text), f in zip(rows, of, strict=True):
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        w = sum(gain[x] for x in f)
        out.append([name, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= 20])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling_of_the_table(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain_resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in bench.collect()])
    assert nodes(queries.op13_resampling(spark, sf_dir)) == want
    assert sum(r[4] is not None for r in want) > 3


@pytest.mark.parametrize("slice_words", [1, 2, 7, 1 << 16])
def test_features_do_not_depend_on_slices(slice_words, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", slice_words)
    draw, join = random.Random(1), resampling.Joiner()
    texts = [" ".join(draw.choice(["a", "Bb", "Zürich", "x" * draw.randint(1, 200), "don't", "日本"]) for _ in range(draw.choice([0, 1, 2, 40]))) for _ in range(30)]
    got = sorted((d, f) for _, of, found in resampling.features((t.encode() for t in texts), join) for d, f in zip(of.tolist(), found.tolist(), strict=True))
    words = [WORD.findall(t.translate(FOLD)) for t in texts]
    assert got == sorted((d, zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000) for d, w in enumerate(words) for n in (1, 2, 3) for k in range(len(w) - n + 1))


@pytest.mark.parametrize("segment_rows", [1, 3, 1 << 20])
def test_ranks_with_ties_repeats_and_odd_rows(spark, odd, segment_rows, monkeypatch):
    monkeypatch.setattr(resampling, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(resampling, "SEGMENTS", 1)
    more = [(8, "one two three " * 8)] * 40 + [(None, "four five six " * 9)] * 20 + [(k, f"seven eight {k % 5} " * 7) for k in range(100, 220)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(6)
    target = spark.createDataFrame([("one two three four", 1), (None, 2)], "text string, rank int")
    got = resampling.resample(df, target, percent=60)
    assert nodes(got) == plain_resampled(ODD + more, ["one two three four", None], 60)
    assert [resampling.resample(x, target).count() for x in (odd, odd.limit(0))] == [len(ODD), 0]
    assert resampling.resample(df, target.limit(0), percent=0).where("rank IS NOT NULL").count() == 0


def test_words_encode_as_whole_texts_do(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5000)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = packing.encoder(f.read())
    draw, letters = random.Random(2), "abzABZéÉüßİıſ'’\"-.,!?#$%<|>()12٣日本語ا́  \u0085\x1c\t \n\x0bǅªⅣ²_Å"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))).encode() for _ in range(20000)]
    texts += [b"it's don't 'tis 'twas <|endoftext|> a<|endoftext|>b \"<|startoftext|>\"", b"I'M we'Re 'S 's's"]
    assert type(own) is packing.Words and own.encode(texts) == packing.Whole(own.tokenizer).encode(texts)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert type(packing.encoder(f.read())) is packing.Whole
