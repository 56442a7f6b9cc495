"""The prefix trie of conversations, from padded matrices of turn ids.

Conversations are dealt to shards by ranges of (turn ids, conversation id), so copies of one conversation, or all that begin
with one turn, spread over as many shards as they fill. A shard numbers its turns, sorts the padded matrix by its columns
(numpy's lexsort) and marks where a column differs from the row above; marks OR-accumulated along a row say where a node of
each depth starts, and sums between starts (reduceat) aggregate a depth at once. A node that touches a shard's first or last
row may go on in the next shard: the shard hands these two rows on, with the sums along them. They are few, and are folded
in the same way until one shard holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Columns of a matrix at once, rows of a shard at most, rows that one task may fold, rows below which shards are not cut.
COLUMNS, SHARD_ROWS, ONE_SHARD, LEAST = 32, 1 << 16, 4096, 1024
_SUMS = ("n", "low", "saved", "leaves", "kids")
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SCHEMA = f"kind int, {_NODE}, node binary, parent binary, ids array<long>, lens array<long>, {', '.join(f'{c} array<long>' for c in _SUMS)}, ends binary"
_NONE = hashlib.sha256(b"").hexdigest()
_FAR = np.iinfo(np.int64).max


def _joined(names: np.ndarray) -> bytes:
    return ",".join(map(str, names.tolist())).encode()


class Shard:
    """Rows (turn ids as pairs of 64 bits, lengths of texts, sums along the path) and what folding them finds.

    ``sums`` holds, for each depth of each row, conversations, smallest name, and what hangs below that depth's node but
    not below the row's next one: tokens saved, leaves, children. Without it every row is one conversation.
    """

    def __init__(self, size: np.ndarray, pairs: np.ndarray, name: np.ndarray, lens: np.ndarray, sums: dict[str, np.ndarray] | None = None) -> None:
        self.size, self.pairs, self.name, self.lens = size, pairs, name, lens
        self.at = np.cumsum(size) - size
        self.plain = sums is None
        if sums is None:
            cells = int(size.sum()) + len(size)
            zero = np.zeros(cells, np.int64)
            sums = {"n": np.ones(cells, np.int64), "low": np.repeat(name, size + 1), "saved": zero, "leaves": zero, "kids": zero}
        self.sums = sums
        self.turn = self._numbered()
        self.order = self._sorted()
        # From here on rows are in order.
        self.rows, self.deep = len(size), size[self.order]
        self.first, self.path, self.names = self.at[self.order], (self.at + np.arange(len(size)))[self.order], name[self.order]
        self.starts = self._starts()

    def _numbered(self) -> np.ndarray:
        """Turns as numbers from 1, in the order of their pairs; 0 pads."""
        by = np.lexsort((self.pairs[:, 1], self.pairs[:, 0]))
        new = np.ones(len(by), np.int64)
        new[1:] = (self.pairs[by[1:]] != self.pairs[by[:-1]]).any(axis=1)
        out = np.empty(len(by), np.int64)
        out[by] = np.cumsum(new)
        return out

    def _padded(self, rows: np.ndarray, at: int) -> np.ndarray:
        place = at + np.arange(COLUMNS)
        inside = place < self.size[rows][:, None]
        return np.where(inside, self.turn[np.where(inside, self.at[rows][:, None] + place, 0)], 0)

    def _sorted(self) -> np.ndarray:
        """Rows by turns, shorter ones first, then by name: the matrix is sorted from its last columns to its first, and
        only rows that reach a column are in its matrix."""
        by_name, order = np.argsort(self.name, kind="stable"), np.empty(0, np.int64)
        reach = self.size[by_name]
        for at in range((int(self.size.max(initial=0)) - 1) // COLUMNS * COLUMNS, -1, -COLUMNS):
            rows = np.concatenate([by_name[(reach > at) & (reach <= at + COLUMNS)], order])
            order = rows[np.lexsort(self._padded(rows, at).T[::-1])]
        return np.concatenate([by_name[reach == 0], order])

    def _starts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth: the rows that reach it, and where among these its nodes start."""
        found = [(np.arange(self.rows), np.zeros(min(1, self.rows), np.int64))]
        differs = np.ones(self.rows, bool)
        differs[1:] = False
        for at in range(0, int(self.deep.max(initial=0)), COLUMNS):
            rows = np.flatnonzero(self.deep > at)
            m = self._padded(self.order[rows], at)
            change = np.ones(m.shape, bool)
            change[1:] = m[1:] != m[:-1]
            # A shorter row between two rows means that they differ before it ends.
            change[:, 0] |= differs[rows] | (np.diff(rows, prepend=-2) > 1)
            change = np.logical_or.accumulate(change, axis=1)
            differs[rows] = change[:, -1]
            for k in range(min(COLUMNS, int(self.deep.max()) - at)):
                reach = self.deep[rows] > at + k
                found.append((rows[reach], np.flatnonzero(change[reach, k])))
        return found

    def keys(self, row: int) -> list[bytes]:
        """A name for the node at each depth of a row that is the same in every shard."""
        h = hashlib.blake2b(digest_size=16)
        out, data = [h.digest()], np.ascontiguousarray(self.pairs[self.first[row] : self.first[row] + self.deep[row]]).tobytes()
        for k in range(0, len(data), 16):
            h.update(data[k : k + 16])
            out.append(h.digest())
        return out

    def fold(self, last: bool) -> tuple[list[dict], list[dict], list[dict]]:
        """Nodes that are complete, the rows to hand on, and the ends of conversations in nodes that are not."""
        total = {c: np.zeros(self.rows, np.int64) for c in ("saved", "leaves")}
        levels: list[dict] = [{} for _ in self.starts]
        below: dict | None = None
        for depth in range(len(self.starts) - 1, -1, -1):
            rows, st = self.starts[depth]
            own = {c: self.sums[c][self.path[rows] + depth] for c in _SUMS}
            at = rows[st]
            open_ = np.zeros(len(st), bool)
            if not last and len(st):
                open_[0] |= rows[0] == 0
                open_[-1] |= rows[-1] == self.rows - 1
            n, low = np.add.reduceat(own["n"], st), np.minimum.reduceat(own["low"], st)
            kids = np.add.reduceat(own["kids"], st)
            if below is not None:
                below["parent"] = np.searchsorted(at, below["at"], side="right") - 1
                kids += np.bincount(below["parent"][~below["open"]], minlength=len(st))
            text = self.lens[self.first[at] + depth - 1] if depth else np.zeros(len(st), np.int64)
            for c, v in (("saved", (n - 1) * text), ("leaves", (kids == 0).astype(np.int64))):
                total[c][rows] += own[c]
                total[c][at] += np.where(open_, 0, v)
            level = {"at": at, "open": open_, "n": n, "low": low, "kids": kids, "ends": np.add.reduceat((self.deep[rows] == depth).astype(np.int64), st)}
            level |= {c: np.add.reduceat(total[c][rows], st) for c in total}
            levels[depth] = below = level
        return self._nodes(levels), [] if last else self._edges(levels), self._ends(levels)

    def _nodes(self, levels: list[dict]) -> list[dict]:
        out, keys = [], {}
        key = lambda row, depth: (keys.get(row) or keys.setdefault(row, self.keys(row)))[depth]
        for depth, x in enumerate(levels):
            up = levels[depth - 1] if depth else None
            for k in np.flatnonzero(~x["open"]).tolist():
                row = int(x["at"][k])
                node = {"kind": 0, "conv_id": int(x["low"][k]), "depth": depth, "n_convs": int(x["n"][k]), "n_children": int(x["kids"][k]), "n_leaves": int(x["leaves"][k]), "saved_tokens": int(x["saved"][k])}
                if up is not None:
                    p = int(x["parent"][k])
                    if up["open"][p]:
                        node["parent"] = key(row if not self.plain else 0 if p == 0 and up["at"][0] == 0 else self.rows - 1, depth - 1)
                    else:
                        node["parent_conv_id"] = int(up["low"][p])
                if self.plain:
                    names = self.names[row : row + x["ends"][k]]
                    node["ends_sha256"] = hashlib.sha256(_joined(names)).hexdigest() if len(names) else _NONE
                else:
                    node["node"] = key(row, depth)
                out.append(node)
        return out

    def _edges(self, levels: list[dict]) -> list[dict]:
        """The first and the last row with the sums along them; what both share counts with the first."""
        out = []
        for row in dict.fromkeys((0, self.rows - 1)):
            sums = {c: [] for c in _SUMS}
            for depth in range(int(self.deep[row]) + 1):
                x = levels[depth]
                k = 0 if row == 0 else len(x["at"]) - 1
                if row and x["at"][k] == 0:
                    values = (0, _FAR, 0, 0, 0)
                else:
                    rest = {c: int(x[c][k]) for c in ("saved", "leaves")}
                    if depth + 1 < len(levels):
                        under = levels[depth + 1]
                        for j in np.flatnonzero(under["open"] & (under["parent"] == k)).tolist():
                            rest = {c: v - int(under[c][j]) for c, v in rest.items()}
                    values = (int(x["n"][k]), int(x["low"][k]), rest["saved"], rest["leaves"], int(x["kids"][k]))
                for c, v in zip(_SUMS, values, strict=True):
                    sums[c].append(v)
            mine = slice(self.first[row], self.first[row] + self.deep[row])
            out.append({"kind": 1, "conv_id": int(self.names[row]), "ids": self.pairs[mine].ravel().tolist(), "lens": self.lens[mine].tolist(), **sums})
        return out

    def _ends(self, levels: list[dict]) -> list[dict]:
        out = []
        if self.plain:
            edges = {row: self.keys(row) for row in {0, self.rows - 1}}
            for depth, x in enumerate(levels):
                for k in np.flatnonzero(x["open"] & (x["ends"] > 0)).tolist():
                    row = int(x["at"][k])
                    names = self.names[row : row + x["ends"][k]]
                    out.append({"kind": 2, "conv_id": int(names[0]), "node": edges[0 if row == 0 else self.rows - 1][depth], "ends": names.astype("<i8").tobytes()})
        return out


def _lists(t: pa.Table, c: str) -> tuple[np.ndarray, np.ndarray]:
    col = t[c].combine_chunks()
    return pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(col).to_numpy(zero_copy_only=False)


def _folded(plain: bool, last: bool, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        size, lens = _lists(t, "lens")
        sums = None if plain else {c: _lists(t, c)[1] for c in _SUMS}
        shard = Shard(size, _lists(t, "ids")[1].reshape(-1, 2), t["conv_id"].to_numpy(), lens, sums)
        for found in shard.fold(last):
            for k in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pylist(found[k : k + 10_000], schema=schema)

    return rows


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of a node's ends from its parts in order, of which one is in memory at a time."""
    node, h = None, hashlib.sha256()
    out = lambda: pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "sha": [h.hexdigest()]})
    for b in batches:
        for key, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if key != node:
                if node is not None:
                    yield out()
                node, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(_joined(np.frombuffer(part.as_buffer(), "<i8")))
    if node is not None:
        yield out()


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, ids, lens) of each conversation: the first h turns of conversation c - c % group, then its own turns after
    the first h; h is crc32 of the written conv_id modulo ``heads``. ids holds two hashes a turn.

    Turns are in the order of ``turn``, null first; of equal ones the order is that of their hashes, and repeated rows are
    turns of their own. A null role or text is empty. Rows without a conv_id belong to no conversation. A conversation
    is one row: 24 bytes a turn in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).cast("long").alias("n"))
    own = save(conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "turns")
    base = own.where(F.pmod("conv_id", F.lit(group)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.join(base, F.col("conv_id") - F.pmod("conv_id", F.lit(group)) == F.col("base"), "left").withColumn("h", h)
    turns = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), F.slice("turns", F.col("h") + 1, F.size("turns")))
    made = joined.select("conv_id", turns.alias("turns"))
    return made.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("ids"), F.transform("turns", lambda t: t["n"]).alias("lens"))


def trie(rows: DataFrame, shard_rows: int = SHARD_ROWS, one_shard: int = ONE_SHARD, least: int = LEAST) -> DataFrame:
    """One row per node of the trie over (conv_id, ids, lens), as rebuilt() gives them; the root is the node of depth 0.

    conv_id and parent_conv_id are the smallest members. Conversations without turns are members of the root alone. No
    conversation gives no node, not even a root.
    """
    spark = rows.sparkSession
    # An empty frame knows the Arrow schema that Spark expects of the rows.
    schema = spark.createDataFrame([], _SCHEMA).toArrow().schema
    rows, levels = save(rows, "rebuilt"), []
    while True:
        n = rows.count()
        last = n <= one_shard
        shards = min(max(-(-n // shard_rows), 64), -(-n // least))
        dealt = rows.repartition(1) if last else rows.repartitionByRange(shards, "ids", "conv_id")
        levels.append(save(dealt.mapInArrow(_folded(not levels, last, schema), _SCHEMA), f"trie-{len(levels)}"))
        if last:
            break
        rows = levels[-1].where("kind = 1").select("conv_id", "ids", "lens", *_SUMS)
    names = [c.split()[0] for c in _NODE.split(", ")]
    nodes = [x.where("kind = 0").select(*names, "node", "parent") for x in levels]
    if len(levels) == 1:
        return nodes[0].select(*names)
    upper = nodes[1]
    for x in nodes[2:]:
        upper = upper.unionByName(x)
    ends = levels[0].where("kind = 2").select("node", "ends", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ends").mapInArrow(_hashed, "node binary, sha string")
    upper = save(upper.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NONE))).drop("sha"), "upper")
    every = nodes[0].unionByName(upper)
    # Parents that shards share got their smallest member above; all others know it.
    known = every.where("parent IS NULL").select(*names)
    found = every.where("parent IS NOT NULL").drop("parent_conv_id").join(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    return known.unionByName(found.select(*names))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations; see rebuilt() and trie() for nulls, ties, repeats and empty tables. Columns other
    than conv_id, turn, role and text are not read."""
    return trie(rebuilt(conversations))
