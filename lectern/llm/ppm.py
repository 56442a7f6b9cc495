"""Language identification by prediction by partial matching.

For each language the training texts give counts of every byte in the context of up to three bytes before it, A-Z in
lower case. Each order is a level of the language's context tree; escape method C leads from a context that has not
seen a byte to the next shorter one. The counts are frozen into code lengths, and a text's cost in a language is the
exact sum over its bytes. The shortest code wins. Languages are scored in groups, and trees in slices of their contexts,
whose tables are bounded; no branch is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save

#: Branches of the deepest level, for each language of a group, that a task holds at a time. A tree with more is cut into
#: slices by the two bytes before a byte, which lead to all branches that code it; every branch is in one slice.
NODES = 1 << 18
#: Languages whose tables one task holds at a time.
GROUP = 8
_SLOTS = 1 << 22


def grams(text: bytes) -> np.ndarray:
    """For each byte the three bytes before it and its own, as one number; a text starts after three zeros."""
    c = np.zeros(len(text) + 3, np.uint32)
    c[3:] = np.frombuffer(text.lower(), np.uint8)
    return (c[:-3] << 24) | (c[1:-2] << 16) | (c[2:-1] << 8) | c[3:]


def _count_rows(flush: int = 1 << 22):
    """(lang, gram, n) of a partition, combined before the shuffle; all languages together hold at most flush grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                g = grams(t.as_buffer().to_pybytes())
                held.setdefault(lang, []).append(g)
                size += len(g)
                if size >= flush:
                    yield from give()
                    size = 0
        yield from give()

    return run


def tree_counts(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, level, gram, n): the branches of each language's tree, a gram of level + 1 bytes each, level 0 to 3.

    All rows with text and language are counted, and all branches are in the table, which is written.
    """
    known = rows.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull() & (F.col(f"`{text_col}`") != ""))
    slim = known.select(F.col(f"`{text_col}`").cast("binary").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    full = save(slim.mapInArrow(_count_rows(), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    levels = [full.select("lang", F.lit(3).alias("level"), "gram", "n")]
    for level in (2, 1, 0):
        shorter = levels[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * (level + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        levels.append(shorter.select("lang", F.lit(level).alias("level"), "gram", "n"))
    every = levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3])
    return save(every, "tree")


def _cuts(sizes: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of contexts of two bytes with about ``most`` branches each, all contexts together; one context is never cut."""
    out, low, held = [], 0, 0
    for context in sorted(sizes):
        if held and held + sizes[context] > most:
            out.append((low, context))
            low, held = context, 0
        held += sizes[context]
    return [*out, (low, 1 << 16)]


def tables(langs: list[str], lang: np.ndarray, level: np.ndarray, gram: np.ndarray, n: np.ndarray) -> dict:
    """Code lengths in bits of the languages side by side, as plain arrays: they travel to tasks by value.

    deep and mid: (sorted grams, bits by gram and language) of the levels 3 and 2; escapes: (contexts, bits) of level 3;
    flat: bits of level 1; leave: escape bits of level 2.
    """
    k = len(langs)

    def shares(lv: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(grams, contexts, bits where seen else inf, escape bits by context, place of each gram's context)."""
        own = level == lv
        known, at = np.unique(gram[own], return_inverse=True)
        ctx, of = np.unique(known >> 8, return_inverse=True)
        counts = np.zeros((len(known), k))
        np.add.at(counts, (at, lang[own]), n[own])
        total, kinds = np.zeros((len(ctx), k)), np.zeros((len(ctx), k))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(counts > 0, np.log2(total + kinds)[of] - np.log2(counts), np.inf)
            away = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
        return known, ctx, bits, away, of

    def settle(bits: np.ndarray, away: np.ndarray, below: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(bits), bits, away + below)

    known, _, bits, away, _ = shares(0)
    root = np.full((256, k), 8.0) + (away[0] if len(away) else 0.0)
    root[known] = settle(bits, away[:1] if len(away) else np.zeros((1, k)), np.full((len(known), k), 8.0))
    known, ctx, bits, away, of = shares(1)
    flat = np.tile(root, (256, 1))
    leave = np.zeros((256, k))
    leave[ctx] = away
    flat += np.repeat(leave, 256, axis=0)
    flat[known] = settle(bits, away[of], root[known & 0xFF])
    known2, ctx, bits, away, of = shares(2)
    leave = np.zeros((1 << 16, k), np.float32)
    leave[ctx] = away
    mid = settle(bits, away[of], flat[known2 & 0xFFFF])
    known3, ctx3, bits, away, of = shares(3)
    short = known3 & 0xFFFFFF
    at = np.minimum(np.searchsorted(known2, short), max(len(known2) - 1, 0))
    hit = known2[at] == short if len(known2) else np.zeros(len(short), bool)
    below = leave[short >> 8] + flat[short & 0xFFFF]
    below[hit] = mid[at[hit]]
    deep = settle(bits, away[of], below)
    small = lambda x: x.astype(np.float32)
    return {"langs": langs, "deep": (known3, small(deep)), "escapes": (ctx3, small(away)), "mid": (known2, small(mid)), "flat": small(flat), "leave": leave}


def _finder(known: np.ndarray):
    """A lookup of numbers in known: their places, -1 for others. Numbers meet in slots by hash."""
    mix = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)
    slot = mix(known)
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    start = np.full(_SLOTS + 1, -1, np.int32)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    start[slot[first]] = first
    longest = int(np.diff(np.append(first, len(slot))).max()) if len(slot) else 0
    keys = np.append(known[order], np.full(longest, -1))
    place = np.append(order, np.full(longest, -1))

    def find(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        at = start[mix(x)]
        rest = np.flatnonzero(at >= 0)
        at = at[rest].astype(np.int64)
        for _ in range(longest):
            same = keys[at] == x[rest]
            out[rest[same]] = place[at[same]]
            rest, at = rest[~same], at[~same] + 1
            if not len(rest):
                break
        return out

    return find


def coder(t: dict):
    """cost(text): bits of the whole text in each language of the tables; of a slice, the bits of its contexts."""
    deep, escape, mid = (_finder(t[x][0]) for x in ("deep", "escapes", "mid"))
    low, high = t.get("slice", (0, 1 << 16))
    whole = (low, high) == (0, 1 << 16)

    def cost(text: bytes) -> np.ndarray:
        total = np.zeros(len(t["langs"]))
        add = lambda x: np.add(total, x.sum(axis=0, dtype=np.float64), out=total)
        # Long texts go piece by piece; a piece reads the three bytes before it.
        for at in range(0, len(text), 1 << 18):
            back = min(at, 3)
            g = grams(text[at - back : at + (1 << 18)])[back:].astype(np.int64)
            if not whole:
                context = (g >> 8) & 0xFFFF
                g = g[(context >= low) & (context < high)]
            place = deep(g)
            found = place >= 0
            add(t["deep"][1].take(place[found], axis=0))
            if found.all():
                continue
            g = g[~found]
            place = escape(g >> 8)
            add(t["escapes"][1].take(place[place >= 0], axis=0))
            g &= 0xFFFFFF
            place = mid(g)
            found = place >= 0
            add(t["mid"][1].take(place[found], axis=0))
            g = g[~found]
            if len(g):
                add(t["leave"].take(g >> 8, axis=0))
                add(t["flat"].take(g & 0xFFFF, axis=0))
        return total

    return cost


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", nodes: int = NODES, group: int = GROUP) -> list[dict]:
    """The tables of the rows' languages, ``group`` languages each; none if no row has text and language.

    A group of more than group * nodes branches is several tables with the same ``langs``, a slice of the contexts each. What
    comes to the driver is one slice's branches at a time: at most group * (2 * nodes + 2**17) rows.
    """
    tree = tree_counts(rows, text_col, lang_col)
    langs = sorted(r["lang"] for r in tree.where("level = 0").select("lang").distinct().collect())
    out = []
    for k in range(0, len(langs), group):
        part = langs[k : k + group]
        codes = {x: j for j, x in enumerate(part)}
        # A dictionary of the language would travel with every row; its number does not.
        number = F.coalesce(*(F.when(F.col("lang") == x, j) for x, j in codes.items()))
        own = tree.select(number.alias("lang"), "level", "gram", "n").where("lang IS NOT NULL")
        # The two bytes before a branch's own; there are 65,536 of them.
        own = own.withColumn("context", F.shiftright("gram", 8).bitwiseAND(0xFFFF))
        sizes = {r["context"]: r["n"] for r in own.where("level = 3").groupBy("context").agg(F.count("*").alias("n")).collect()}
        for low, high in _cuts(sizes, group * nodes):
            got = own.where((F.col("level") < 2) | ((F.col("context") >= low) & (F.col("context") < high))).toArrow()
            lang, level, gram, n = (got[c].to_numpy() for c in ("lang", "level", "gram", "n"))
            out.append(tables(part, lang, level, gram, n.astype(float)) | {"slice": (low, high)})
    drop_saved(tree)
    return out


def _predicted(docs: DataFrame, model: dict) -> DataFrame:
    """(id, row, bytes, lang, cost, mass) by one group of languages; mass: the group's weight if the best has 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, cost = sent.value["langs"], coder(sent.value)
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            for t, letters in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                row = (None, None, None, None)
                if letters:
                    text = t.as_buffer().to_pybytes()
                    c = cost(text)
                    k = int(c.argmin())
                    row = (len(text), langs[k], float(c[k]), float(np.exp2(np.maximum(c[k] - c, -1000.0)).sum()))
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, x) for c, x in zip(cols, kinds, strict=True))], ["id", "row", "bytes", "lang", "cost", "mass"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, row long, bytes long, lang string, cost double, mass double")


def _summed(docs: DataFrame, slices: list[dict]) -> DataFrame:
    """What _predicted gives, for a group of languages whose tree is in slices: each slice reads the texts and gives its part
    of every language's cost."""
    langs, parts = slices[0]["langs"], []
    id_type = docs.schema["id"].dataType.simpleString()
    for m in slices:
        sent = docs.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cost = coder(sent.value)
            for b in batches:
                texts = [t.as_buffer().to_pybytes() if letters else None for t, letters in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
                size, costs = [None if t is None else len(t) for t in texts], [None if t is None else cost(t).tolist() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(costs, pa.list_(pa.float64()))], ["id", "row", "bytes", "costs"])

        parts.append(save(docs.mapInArrow(run, f"id {id_type}, row long, bytes long, costs array<double>"), "slice-costs"))
    every = parts[0].drop("id").distinct()
    for p in parts[1:]:
        every = every.unionByName(p.drop("id").distinct())
    sums = every.groupBy("row").agg(F.first("bytes").alias("bytes"), *(F.sum(F.get("costs", F.lit(k))).alias(f"c{k}") for k in range(len(langs))))
    each = F.array(*(F.struct(F.col(f"c{k}").alias("cost"), F.lit(k).alias("k"), F.lit(x).alias("lang")) for k, x in enumerate(langs)))
    best = sums.withColumn("b", F.when(F.col("bytes").isNotNull(), F.array_min(each)))
    mass = sum((F.pow(F.lit(2.0), F.greatest(F.col("b.cost") - F.col(f"c{k}"), F.lit(-1000.0))) for k in range(len(langs))), F.lit(0.0))
    return parts[0].select("id", "row").join(best.select("row", "bytes", "b.lang", "b.cost", mass.alias("mass")), "row").select("id", "row", "bytes", "lang", "cost", "mass")


def predict(docs: DataFrame, model: list[dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score, bits_per_byte of each whole text.

    und with score 0 for null texts and texts without a letter, or if nothing was learned. score is the posterior of
    the chosen language under equal priors; equal costs go to the first language by name. Repeated rows each keep a
    row; an empty table gives an empty result; columns of docs other than the two are not read.
    """
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), text.cast("binary").alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not model:
        best = slim.select("id", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("mass"))
    elif len(model) == 1:
        best = _predicted(slim, model[0])
    else:
        # Each group of languages reads the texts; rows of equal id and text have equal results, so one stands for all.
        groups = [list(g) for _, g in groupby(model, key=lambda m: m["langs"])]
        each = [save(_predicted(slim, g[0]) if len(g) == 1 else _summed(slim, g), "costs") for g in groups]
        rows = each[0]
        all_ = each[0].drop("id").distinct()
        for e in each[1:]:
            all_ = all_.unionByName(e.drop("id").distinct())
        per = all_.groupBy("row").agg(F.first("bytes").alias("bytes"), F.min(F.when(F.col("cost").isNotNull(), F.struct("cost", "lang"))).alias("b"), F.collect_list(F.struct("cost", "mass")).alias("m"))
        mass = F.aggregate("m", F.lit(0.0), lambda a, x: a + F.coalesce(x["mass"] * F.pow(F.lit(2.0), F.greatest(F.col("b.cost") - x["cost"], F.lit(-1000.0))), F.lit(0.0)))
        best = rows.select("id", "row").join(per.select("row", "bytes", F.col("b.lang").alias("lang"), F.col("b.cost").alias("cost"), mass.alias("mass")), "row")
    return best.select(F.col("id").alias(id_col), F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col("mass"), F.lit(0.0)).alias("score"), (F.col("cost") / F.col("bytes")).alias("bits_per_byte"))
