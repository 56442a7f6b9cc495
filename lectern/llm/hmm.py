"""Language-model scores from a hidden Markov model over words.

Word counts cover all training texts. The commonest words are symbols of their own; the others share classes by their
last bytes, and a word's share of its class comes from its count. Baum-Welch counts of every training block are summed
over partitions, and the scaled forward recursion gives the exact probability of each whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: The end of a text; no word has a blank in it.
END = b"\n"


@dataclass(frozen=True)
class Settings:
    """states: latent states. symbols: words with a symbol of their own, at most. sent: further words whose counts go to
    every task as 12 bytes each, at most; the counts of all others are joined. classes: those of the other words.
    block: tokens of a training sequence. rounds: of Baum-Welch. prior: tokens by which emissions lean to the unigram."""

    states: int = 6
    symbols: int = 16_384
    sent: int = 1_000_000
    classes: int = 512
    block: int = 256
    rounds: int = 6
    prior: float = 50.0


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*(text or b"").lower().split(), END]


def word_counts(texts: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word binary, n) of the texts in the column text (binary); each task combines before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(tokens(t.as_py()))
                if len(held) >= flush:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _least_count(histogram: list[tuple[int, int]], most: int) -> int:
    """The smallest step n such that at most ``most`` words have a count of n or more."""
    total, least = 0, 1 << 62
    for n, words in sorted(histogram, reverse=True):
        total += words
        if total > most:
            break
        least = n
    return least


@dataclass
class Vocabulary:
    """What every task knows of the words: symbols, counts of the next ones by hash, and the sizes of the classes."""

    code: dict[bytes, int]
    count: np.ndarray  # of each symbol word
    hashes: np.ndarray
    hash_counts: np.ndarray
    class_total: np.ndarray
    total: int
    distinct: int
    least: int

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    # Counts of 64 and over share a step with those of the same leading six bits, so there are a few thousand steps.
    low = F.greatest(F.length(F.bin("n")) - 6, F.lit(0)).cast("int")
    steps = counts.withColumn("low", low).groupBy(F.expr("shiftleft(shiftright(n, low), low)").alias("step"))
    got = steps.agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    histogram = [(r["step"], r["words"]) for r in got]
    own, sent = _least_count(histogram, s.symbols), _least_count(histogram, s.symbols + s.sent)
    head = counts.where(F.col("n") >= own).toArrow()
    words = sorted(zip(head["word"].to_pylist(), head["n"].to_pylist(), strict=True))
    next_ = counts.where((F.col("n") < own) & (F.col("n") >= sent)).select(F.xxhash64(F.col("word").cast("string")).alias("h"), "n").toArrow()
    h, n = next_["h"].to_numpy().view(np.uint64), next_["n"].to_numpy()
    order = np.argsort(h)
    suffix = F.expr(f"crc32(substring(word, -3)) % {s.classes}")
    classes = counts.where(F.col("n") < own).groupBy(suffix.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total = np.full(s.classes, 0.5)  # of each class: its tokens and half a token for each of its words and for new ones
    for r in classes:
        total[r["c"]] = r["n"] + 0.5 * (r["v"] + 1)
    return Vocabulary({w: k for k, (w, _) in enumerate(words)}, np.array([c for _, c in words], np.int64), h[order], n[order].astype(np.uint32), total, sum(r["n"] for r in got), sum(b for _, b in histogram), sent)


def _encode(vocab_of, width: int):
    """Rows (id, row, train, held, text) to symbols and what is known of the counts; hashes of words to be joined stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**vocab_of.value)
        get, first, classes = v.code.get, len(v.code), np.uint32(len(v.class_total))
        log_count, log_class = np.log10(v.count + 0.5), np.log10(v.class_total)

        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(4):
                w = tokens(t.as_py())
                sym = np.fromiter(map(get, w, repeat(-1)), np.int32, len(w))
                own = sym >= 0
                base = float(log_count[sym[own]].sum())
                other = np.flatnonzero(~own)
                rest = [w[k] for k in other.tolist()]
                kind = np.fromiter(map(zlib.crc32, [x[-3:] for x in rest]), np.uint32, len(rest)) % classes
                sym[other] = first + kind
                h = np.fromiter(map(xxhash.xxh64_intdigest, rest, repeat(42)), np.uint64, len(rest))
                at = np.minimum(np.searchsorted(v.hashes, h), max(len(v.hashes) - 1, 0))
                known = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
                log_known = float(np.log10(v.hash_counts[at[known]] + 0.5).sum())
                share = log_known - float(log_class[kind].sum())
                for c, x in zip(cols, (len(w), int(own.sum() + known.sum()), base + log_known, share, sym.astype(np.uint16).tobytes(), h[~known].view(np.int64)), strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "row", "train", "held", "n_tokens", "n_known", "base", "share", "syms", "open"])

    return run


@dataclass
class Model:
    start: np.ndarray  # of texts
    resume: np.ndarray  # of further blocks of a text, in training only
    move: np.ndarray
    emit: np.ndarray  # symbols by states


def first_model(unigram: np.ndarray, s: Settings) -> Model:
    """Emissions near the unigram, apart by a fixed pseudo-random factor; states tend to stay."""
    rng = np.random.default_rng(7)
    emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), s.states)))
    move = np.full((s.states, s.states), 0.02 / max(1, s.states - 1))
    np.fill_diagonal(move, 0.98)
    even = np.full(s.states, 1 / s.states)
    return Model(even, even, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def block_counts(m: Model, sym: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[Model, float]:
    """Expected counts and log-likelihood of blocks (rows of sym, padded) by the scaled forward-backward recursion.

    Padding emits 1, which leaves likelihood and backward values as they are; its counts are masked.
    """
    n, width = sym.shape
    k = len(m.start)
    # Time first, so that each step reads one block of memory. The row after the last symbol is that of padding.
    inside = np.arange(width)[:, None] < length[None, :]
    coded = np.where(inside, sym.T, len(m.emit))
    e = np.vstack([m.emit, np.ones(k)]).astype(np.float32)[coded]
    alpha, scale = np.empty((width, n, k), np.float32), np.empty((width, n, 1), np.float32)
    move, back = m.move.astype(np.float32), np.ascontiguousarray(m.move.T, np.float32)
    ones = np.ones((k, 1), np.float32)  # a product with it sums faster than sum(axis=1)
    a = np.where(first[:, None], m.start, m.resume).astype(np.float32)
    for t in range(width):
        np.multiply(a @ move if t else a, e[t], out=alpha[t])
        np.matmul(alpha[t], ones, out=scale[t])
        alpha[t] /= scale[t]
        a = alpha[t]
    out = Model(np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit))
    beta = np.ones((n, k), np.float32)
    weight = inside.astype(np.float32)[:, :, None]
    for t in range(width - 1, -1, -1):
        if t:
            e[t] *= beta
            e[t] /= scale[t]
            ahead = e[t] @ back
            out.move += (alpha[t - 1] * weight[t]).T @ e[t]
        alpha[t] *= beta  # from here on the posterior
        if t:
            beta = ahead
    out.move *= m.move
    out.start, out.resume = alpha[0][first].sum(axis=0, dtype=np.float64), alpha[0][~first].sum(axis=0, dtype=np.float64)
    flat = coded.ravel()
    for j in range(k):
        out.emit[:, j] = np.bincount(flat, alpha[:, :, j].ravel(), len(m.emit) + 1)[:-1]
    return out, float(np.log(scale).sum(dtype=np.float64))


def _expect(model_of, block: int, at_once: int = 1024):
    """Each task's expected counts: rows (kind, at, values), one for each symbol it saw and each row of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**model_of.value)
        k = len(m.start)
        total, loglik = Model(np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)), 0.0
        held: list[tuple[np.ndarray, bool]] = []

        def settle() -> None:
            nonlocal loglik
            width = max(len(x) for x, _ in held)
            sym = np.zeros((len(held), width), np.int64)
            for j, (x, _) in enumerate(held):
                sym[j, : len(x)] = x
            got, ll = block_counts(m, sym, np.array([len(x) for x, _ in held]), np.array([f for _, f in held]))
            loglik += ll
            for name in ("start", "resume", "move", "emit"):
                getattr(total, name).__iadd__(getattr(got, name))
            held.clear()

        for b in batches:
            for t in b.column(0):
                sym = np.frombuffer(t.as_buffer(), np.uint16)
                for at in range(0, len(sym), block):
                    held.append((sym[at : at + block], at == 0))
                    if len(held) == at_once:
                        settle()
        if held:
            settle()
        seen = np.flatnonzero(total.emit.any(axis=1))
        at = np.concatenate([seen, [-1, -2, -3], np.arange(-4, -4 - k, -1)])
        values = np.vstack([total.emit[seen], total.start, total.resume, np.full(k, loglik), total.move])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(values[:, j]) for j in range(k))], ["at", *(f"v{j}" for j in range(k))])

    return run


def train(encoded: DataFrame, unigram: np.ndarray, s: Settings) -> tuple[Model, list[float]]:
    """Baum-Welch on all training rows; what comes back each round is one row per symbol. (model, log-likelihoods)"""
    sc = encoded.sparkSession.sparkContext
    m, rows, history = first_model(unigram, s), encoded.where("train").select("syms"), []
    schema = "at int, " + ", ".join(f"v{j} double" for j in range(s.states))
    for _ in range(s.rounds):
        sent = sc.broadcast(vars(m))  # plain arrays: tasks need not have the package
        got = rows.mapInArrow(_expect(sent, s.block), schema).groupBy("at").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(s.states))).toArrow()
        at = got["at"].to_numpy()
        values = np.column_stack([got[f"v{j}"].to_numpy() for j in range(s.states)]) if len(at) else np.zeros((0, s.states))
        sent.unpersist()
        special = {int(a): values[k] for k, a in enumerate(at) if a < 0}
        if not special or not (at >= 0).any():
            break
        emit = np.zeros_like(m.emit)
        emit[at[at >= 0]] = values[at >= 0]
        emit = (emit + s.prior * unigram[:, None]) / (emit.sum(axis=0) + s.prior)
        one = lambda x: (x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True)
        m = Model(one(special[-1]), one(special[-2]), one(np.vstack([special[-4 - j] for j in range(s.states)])), emit)
        history.append(float(special[-3][0]))
    return m, history


def forward(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the exact probability of each sequence of symbols, none empty, all in step, the longest first."""
    length = np.array([len(x) for x in texts])
    order = np.argsort(-length, kind="stable")
    flat, length = np.concatenate([texts[k] for k in order]), length[order]
    start = np.cumsum(length) - length
    out, alpha = np.zeros(len(texts)), np.tile(m.start, (len(texts), 1))
    live = len(texts)
    for t in range(int(length[0])):
        while length[live - 1] <= t:
            live -= 1
        a = alpha[:live] if t == 0 else alpha[:live] @ m.move
        a = a * m.emit[flat[start[:live] + t]]
        c = a.sum(axis=1)
        out[:live] += np.log10(c)
        alpha = a / c[:, None]
    back = np.empty(len(texts))
    back[order] = out
    return back


def _score(model_of, at_once: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**model_of.value)
        for b in batches:
            for k in range(0, b.num_rows, at_once):
                part = b.slice(k, at_once)
                texts = [np.frombuffer(t.as_buffer(), np.uint16) for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(part.num_columns - 1)), pa.array(forward(m, texts))], [*part.schema.names[:-1], "log_syms"])

    return run


def score(docs: DataFrame, is_train, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    is_train is a condition on docs' columns; null means neither to learn from the row nor to call it held out. A null
    or empty text is the end alone. Repeated rows each count. With no training row every word is new; an empty table
    gives an empty result. Columns of docs other than those asked for are not read.
    """
    s, sc = settings, docs.sparkSession.sparkContext
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(is_train, F.lit(False)).alias("train"), F.coalesce(~is_train, F.lit(False)).alias("held"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counts = save(word_counts(slim.where("train").select("text")), "word-counts")
    v = vocabulary(counts, s)
    sent = sc.broadcast(vars(v))
    id_type = slim.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row long, train boolean, held boolean, n_tokens long, n_known long, base double, share double, syms binary, open array<long>"
    encoded = save(slim.mapInArrow(_encode(sent, s.classes), schema), "encoded")
    size = np.concatenate([v.count, v.class_total])
    model, _ = train(encoded, size / size.sum(), s)
    # Words that were not sent: their counts are joined, new words have none.
    tail = counts.where(F.col("n") < v.least).select(F.xxhash64(F.col("word").cast("string")).alias("h"), "n")
    opened = encoded.where(F.size("open") > 0).select("row", F.explode("open").alias("h"))
    found = opened.join(tail, "h", "left").groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_open"))
    scored = encoded.select("id", "row", "train", "held", "n_tokens", "n_known", "base", "share", "syms").mapInArrow(
        _score(sc.broadcast(vars(model))), f"id {id_type}, row long, train boolean, held boolean, n_tokens long, n_known long, base double, share double, log_syms double"
    )
    log_open = F.coalesce("log_open", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + log_open - F.col("n_tokens") * math.log10(v.norm)).alias("base_score"),
        (F.col("log_syms") + F.col("share") + log_open).alias("score"),
    )
