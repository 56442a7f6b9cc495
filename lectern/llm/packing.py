"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are at most the capacity, so the plan is made on their histogram: how many pieces of each length lie where. Pieces
above a third of the capacity go at most two to a sequence, by greedy matching (the longest with the longest that still
fits, which pairs as many as can be paired); shorter ones, longest first, go to the smallest gap that holds them. A piece
finds its place by its length and its rank among the pieces of that length, so no task sees more than its own rows, and
the packing is the one that all pieces together have, however many there are.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

CAPACITY = 4096
#: Token ids of pieces of text between blanks that a task remembers, and the longest such piece, in bytes.
REMEMBERED, LONGEST = 1 << 20, 64
#: Bytes of text that a task encodes at once, but for a longer text.
AT_ONCE = 1 << 24


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, end rank, pieces of that length in a sequence, first sequence, offset), and the number of
    sequences. A group is a range of sequences with the same gap.

    Putting as many pieces as fit into a gap leaves less than half of it, so a group is used at most log2(capacity)
    times; a length splits one group at most. So there are some 40 rows a length at most, whatever the counts.
    """
    rest = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        rest[length] = n
    used, rows, groups, opened = np.zeros(capacity + 1, np.int64), [], {}, 0

    def put(length: int, n: int, per: int, seq: int, offset: int) -> None:
        if n:
            rows.append((length, used[length], used[length] + n, per, seq, offset))
            used[length] += n
            rest[length] -= n

    def group(gap: int, seq: int, n: int) -> None:
        if n and gap:
            groups.setdefault(gap, []).append((seq, n))

    third = capacity // 3
    for a in range(capacity, third, -1):
        while rest[a]:
            fits = np.flatnonzero(rest[third + 1 : capacity - a + 1])
            b = third + 1 + int(fits[-1]) if len(fits) else 0
            if b >= a and rest[a] > 1:
                n = int(rest[a] // 2)
                put(a, 2 * n, 2, opened, 0)
                group(capacity - 2 * a, opened, n)
            else:
                if b >= a:  # a single one is left: the longest shorter partner
                    fits = fits[fits < a - third - 1]
                    b = third + 1 + int(fits[-1]) if len(fits) else 0
                n = int(min(rest[a], rest[b])) if b else int(rest[a])
                put(a, n, 1, opened, 0)
                if b:
                    put(b, n, 1, opened, a)
                group(capacity - a - b, opened, n)
            opened += n
    for a in range(third, 0, -1):
        for gap in sorted(g for g in groups if g >= a):
            while rest[a] and groups[gap]:
                seq, m = groups[gap].pop()
                per, offset = gap // a, capacity - gap
                full = int(min(m, rest[a] // per))
                put(a, full * per, per, seq, offset)
                group(gap - per * a, seq, full)
                if full < m:
                    some = int(rest[a])
                    put(a, some, max(some, 1), seq + full, offset)
                    group(gap - some * a, seq + full, 1)
                    group(gap, seq + full + 1, m - full - 1)
            if not rest[a]:
                break
        if rest[a]:
            per = capacity // a
            full, some = divmod(int(rest[a]), per)
            put(a, full * per, per, opened, 0)
            group(capacity - per * a, opened, full)
            put(a, some, max(some, 1), opened + full, 0)
            group(capacity - some * a, opened + full, int(some > 0))
            opened += full + (some > 0)
    found = np.array(rows, np.int64).reshape(-1, 6)
    return found[np.lexsort((found[:, 1], found[:, 0]))], opened


#: The pre-tokenizer that never joins what a blank parts, and ends a token at the border of letters and marks (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks, a word of letters, marks; a mark before a word is no apostrophe.
_WORD = re.compile(rb"([!-&(-/:-@[-`{-~]*)([A-Za-z\x80-\xff]+)([!-/:-@[-`{-~]*)")
_JOINED = 2000
BLANKS = re.compile(r"\s")


class Whole:
    """Token ids, as bytes, of whole texts: for any tokenizer."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def encode(self, raws: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in raws], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


class Words(Whole):
    """The same for a tokenizer that works within words: what stands between ASCII blanks is encoded once and remembered.

    New words go through the tokenizer many at a time with blanks between; each ends with a token that ends a word.
    """

    def __init__(self, tokenizer, special: list[str]) -> None:
        super().__init__(tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in special) or b"(?!)")
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters below U+0300, which no normal form changes: one each for the tokenizer."""
        groups = [words[k : k + _JOINED] for k in range(0, len(words), _JOINED)]
        for own, ids in zip(groups, super().encode([b" ".join(g) for g in groups]), strict=True):
            stops = 4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)
            if len(stops) != len(own) or stops[-1] != len(ids):
                raise ValueError("a word of the tokenizer does not end where it should")
            starts = [0, *stops[:-1].tolist()]
            self.known.update((w, ids[a:b]) for w, a, b in zip(own, starts, stops.tolist(), strict=True))

    def _meet(self, new: list[bytes]) -> None:
        known, whole, parted, words = self.known, set(), [], set()
        match, special = _WORD.fullmatch, self.special.search
        for p in new:
            m = match(p)
            if not m or special(p):
                whole.add(p)
                continue
            before, word, after = m.groups()
            if word.isascii():
                word = word.lower()
            elif not _plain(word):
                whole.add(p)
                continue
            if word not in known:
                words.add(word)
            if before and before not in known:
                whole.add(before)
            if after and after not in known:
                whole.add(after)
            if word != p:
                parted += (p, before, word, after)
        self._learn(list(words))
        rest = list(whole)
        known.update(zip(rest, super().encode(rest), strict=True))
        known[b""] = b""
        each = iter(parted)
        for p, before, word, after in zip(each, each, each, each, strict=True):
            known[p] = known[before] + known[word] + known[after]

    def encode(self, raws: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(raws), 256):
            pieces = [r.split() for r in raws[at : at + 256]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = set().union(*pieces).difference(self.known)
            self._meet(list(new))
            out += [b"".join(map(self.known.__getitem__, p)) for p in pieces]
            for p in new:
                if len(p) > LONGEST:
                    del self.known[p]
        return out


def _plain(word: bytes) -> bool:
    """Letters only, all below U+0300; the dotted capital I becomes two characters in lower case."""
    text = word.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0300" and "\u0130" not in text


def encoder(definition: str) -> Whole:
    """What encodes with the tokenizer of this definition."""
    from tokenizers import Tokenizer

    d = json.loads(definition)
    steps = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (d["normalizer"] or {}).get("normalizers", [])]
    split = ((d["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    within = steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and d["model"].get("end_of_word_suffix") == "</w>"
    special = [x["content"] for x in d["added_tokens"]]
    within &= not any(BLANKS.search(x) for x in special)
    return Words(Tokenizer.from_str(definition), special) if within else Whole(Tokenizer.from_str(definition))


def worker_encoder(definition: str) -> Whole:
    """The encoder of this Python worker: Spark reuses workers, so a task finds the words that tasks before it met."""
    held = sys.__dict__.setdefault("_lectern_encoder", {})
    if definition not in held:
        held.clear()
        held[definition] = encoder(definition)
    return held[definition]


def _bounded(own_encoder: Whole, raws: Iterator[bytes], end: bytes) -> Iterator[bytes]:
    held, size = [], 0
    for raw in raws:
        held.append(raw)
        size += len(raw)
        if size >= AT_ONCE:
            yield from (x + end for x in own_encoder.encode(held))
            held, size = [], 0
    yield from (x + end for x in own_encoder.encode(held))


def _pieces(tokenizer, capacity: int, end_id: int, keep_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own_encoder, end = worker_encoder(tokenizer.value), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            pick, cols, ids = [], [[] for _ in range(4)], []
            raws = (text.as_buffer().to_pybytes() if text.is_valid else b"" for text in b.column(1))
            for k, data in enumerate(_bounded(own_encoder, raws, end)):
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    pick.append(k)
                    for c, v in zip(cols, (piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        c.append(v)
                    if keep_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            length = np.array(cols[2], np.int64)
            order = np.argsort(length, kind="stable")
            own, first, n = np.unique(length[order], return_index=True, return_counts=True)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(first - seen[own], n)
            seen[own] += n
            out = [b.column(0).take(pa.array(pick, pa.int32())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(np.full(len(pick), task), pa.int32()), pa.array(place)]
            names = ["id", "piece", "start", "length", "crc", "task", "place"]
            if keep_ids:
                cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids or [np.empty(0, np.int32)]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return rows


def _placed(places: np.ndarray, at: int):
    """Sequence and offset of each row by its length and rank."""
    key = (places[:, 0] << 44) + places[:, 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            own = places[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            nth = rank - own[:, 1]
            cols = [b.column(k) for k in range(at)] + [pa.array(own[:, 4] + nth // own[:, 3]), pa.array(own[:, 5] + nth % own[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:at], "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each row of docs: id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids
    the token ids (after length).

    A row's ids are its text's, then end_id; only more than ``capacity`` of them are cut. A null or empty text is the end
    alone. Rows with a null or repeated id, and rows repeated in full, are packed one by one. An empty table gives an
    empty result. Other columns are not read. The tokenizer's file is read where the driver runs and sent to the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, crc long, task int, place long" + ", ids array<int>" * keep_ids
    cut = save(slim.mapInArrow(_pieces(tokenizer, capacity, end_id, keep_ids), schema), "pieces")
    # Ranks within a length: how many the tasks before had, then the place in the own task.
    counts = save(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    kept = ["id", "piece", "start", "length", "crc"] + ["ids"] * keep_ids
    ranked = cut.join(starts, ["task", "length"]).select(*kept, (F.col("before") + F.col("place")).alias("rank"))
    types = dict(cut.dtypes)
    out = ranked.mapInArrow(_placed(places, len(kept)), ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long")
    return out.withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of what pack() gave with keep_ids: the rows to train on."""
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    return own.select("sequence_id", "n_tokens", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"))
