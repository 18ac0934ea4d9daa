"""Prefix trie over conversations: shared beginnings, and what reusing them would save.

1. Every member's turns are numbered and its prefixes named by running sums of hashes of
   (position, turn), a prefix scan that cuts conversations of any length into even slices.
   Equal prefixes have equal names, so a node is a group of rows (member, depth).
2. Only nodes of two members or more need a tree: below a node of one member there is that
   member's own chain, whose values are known.
3. Shared nodes with few rows below them go into shards by their topmost such ancestor. A
   task takes shards in bounded runs and lays them out as a succinct level-order trie:
   LOUDS bits and label arrays. Leaves and savings are rolled up by a reverse BFS
   with ``np.add.at``.
4. The heavy upper levels, with more rows below them than a shard may have, merge
   separately: each takes the totals of the shards under it, then sums up its descendants
   by pointer doubling, in as many rounds as the logarithm of their depth.
5. The ids of members that end at a node are sorted by ranges and joined into pieces where
   they lie; one task streams a node's pieces, and no more than a piece is held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import Sum, running, sliced, whole
from .common import as_written, discard, runs_of, written
from .components import flattened

#: rows below a node above which it is heavy; nodes that a task lays out together; ids in one piece
SHARD_ROWS, BLOCK_NODES, PIECE_IDS = 50_000, 200_000, 50_000


class Louds:
    """A forest in level order: after a super-root, a 1 for each child of each node and a 0 to end it.

    Node i (from 1; 0 is the super-root) is the i-th 1 of the bits; labels, and any other
    column, are arrays in the same order.
    """

    def __init__(self, depth: np.ndarray, key: np.ndarray, parent: np.ndarray):
        """Nodes in any order: depth, key, and the parent's key; those whose parent is not among them are tops."""
        number = {k: i for i, k in enumerate(key.tolist())}
        up = np.fromiter((number.get(p, -1) for p in parent.tolist()), np.int64, len(parent))
        # depths count from the tops, which may lie at any depth of the whole tree
        levels, level = [np.flatnonzero(up < 0)], 0
        by_parent = np.argsort(up, kind="stable")
        starts = np.searchsorted(up[by_parent], np.arange(len(key) + 1))
        while len(levels[level]):
            first, n = starts[levels[level]], starts[levels[level] + 1] - starts[levels[level]]
            levels.append(by_parent[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
            level += 1
        #: rows of the input in level order, and the number of nodes above each level
        self.order = np.concatenate(levels)
        self.bounds = np.concatenate(([0], np.cumsum([len(x) for x in levels])))
        degree = np.concatenate(([len(levels[0])], (starts[1:] - starts[:-1])[self.order]))
        self.bits = np.ones(int(degree.sum()) + len(degree), bool)
        self.bits[np.cumsum(degree + 1) - 1] = False
        self.labels = key[self.order]
        self.degree = degree[1:]

    def parents(self) -> np.ndarray:
        """Of each node the place of its parent in level order, -1 for tops: zeros before its 1 name it."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self, node: int) -> range:
        """Places of a node's children: the 1s between the zeros that end its predecessor and itself."""
        zeros = np.flatnonzero(~self.bits)
        first = int(zeros[node - 1]) + 1 if node else 0
        return range(first - node, int(zeros[node]) - node)

    def rolled_up(self, own: np.ndarray) -> np.ndarray:
        """Sums of a column (in the order of the input) over subtrees, in that order too: a reverse BFS."""
        total, parent = own[self.order].copy(), self.parents()
        for low, high in zip(self.bounds[-2:0:-1].tolist(), self.bounds[:1:-1].tolist(), strict=True):
            np.add.at(total, parent[low:high], total[low:high])
        out = np.empty_like(total)
        out[self.order] = total
        return out


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", slices: int | None = None) -> DataFrame:
    """Rows (conv, n, turn_hash, bytes): turns numbered from 1 in the order of their turn, null first.

    Null roles and texts are empty ones; turns that tie go by hashes of role and text, so
    repeated rows are turns each. Rows without a conversation's id belong to none and are
    left out. Texts are read once, where they lie, and go no further than their hash.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    thin = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.md5(role.cast("binary")).alias("r"), F.md5(text.cast("binary")).alias("t"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
    )
    keys, order = ["conv"], ["turn", "r", "t"]
    n = running(sliced(thin, keys, order, slices), keys, order, n=Sum("one"))
    return whole(n).select("conv", "n", F.concat("r", "t").alias("turn_hash"), "bytes")


def _digits(seed: int) -> Column:
    """63 bits of a turn's place and hash, as a decimal whose sums cannot overflow."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("n"), F.col("turn_hash")), 1).cast("decimal(20,0)")


def _name(depth: Column, *sums: Column) -> Column:
    """A node's name: prefixes of one length are equal where both sums are."""
    return F.unhex(F.md5(F.concat_ws(" ", depth.cast("string"), *(x.cast("decimal(38,0)").cast("string") for x in sums)).cast("binary")))


def members(turns: DataFrame, conversations: DataFrame, slices: int | None = None) -> DataFrame:
    """Rows (conv, n, key, parent, bytes, below, ends), one per member and depth n from 0: its node and that node's parent.

    turns: as `numbered` gives them; conversations: conv, length, one row each, turnless ones too.
    below: the turns that follow; ends: whether there are none.
    """
    roots = conversations.select("conv", F.lit(0).cast("long").alias("n"), F.lit("").alias("turn_hash"), F.lit(0).cast("long").alias("bytes"))
    h1, h2 = _digits(1), _digits(2)
    rows = turns.join(conversations, "conv").withColumns({"h1": h1, "h2": h2})
    zero = F.lit(0).cast("decimal(20,0)")
    rows = rows.unionByName(roots.join(conversations, "conv").withColumns({"h1": zero, "h2": zero}))
    keys, order = ["conv"], ["n"]
    d = whole(running(sliced(rows, keys, order, slices), keys, order, s1=Sum("h1"), s2=Sum("h2")))
    n, s1, s2 = F.col("n"), F.col("s1").cast("decimal(38,0)"), F.col("s2").cast("decimal(38,0)")
    parent = F.when(n > 0, _name(n - 1, s1 - F.col("h1"), s2 - F.col("h2")))
    return d.select("conv", "n", _name(n, s1, s2).alias("key"), parent.alias("parent"), "bytes", (F.col("length") - n).alias("below"), (F.col("length") == n).alias("ends"))


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rolls up shards: of each node its children, the leaves of its subtree and what the subtree saves."""
    for t in runs_of(batches, "shard", BLOCK_NODES):
        column = lambda name: t.column(name).to_numpy()
        n, ends, size = column("n_convs"), column("n_ends"), column("bytes")
        trie = Louds(column("depth"), column("key"), column("parent"))
        parent, shared = trie.parents(), np.zeros(len(n) + 1, np.int64)
        np.add.at(shared, parent, n[trie.order])  # members that go on into children of two members or more; tops meet in the last cell
        in_shared = np.empty(len(n), np.int64)
        in_shared[trie.order] = shared[:-1]
        kids = np.empty(len(n), np.int64)
        kids[trie.order] = trie.degree
        alone = n - ends - in_shared  # each goes on by itself: a child, and one leaf at the end of its chain
        own = alone + (alone + kids == 0)
        yield pa.RecordBatch.from_arrays(
            [t.column("key").combine_chunks(), *(pa.array(x, pa.int64()) for x in (alone + kids, trie.rolled_up(own), trie.rolled_up((n - 1) * size)))],
            ["key", "n_children", "n_leaves", "saved"],
        )


def _heavy(shared: DataFrame, light: DataFrame, most: int) -> DataFrame:
    """(key, n_children, n_leaves, saved) of heavy nodes, a written table. light: the same of the others, with their parents."""
    heavy = shared.filter(F.col("weight") > most)
    told = light.select("parent", "n_convs", "n_leaves", "saved")  # those whose parent is light find no heavy node below
    told = told.unionByName(heavy.select("parent", "n_convs", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
    told = told.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("kids"), *(F.sum(c).alias(f"of_{c}") for c in ("n_convs", "n_leaves", "saved")))
    d = heavy.join(told, "key", "left").na.fill(0, ["kids", "of_n_convs", "of_n_leaves", "of_saved"])
    alone = F.col("n_convs") - F.col("n_ends") - F.col("of_n_convs")
    d = d.select(
        "key", F.col("parent").alias("up"), (alone + F.col("kids")).alias("n_children"),
        (alone + F.when(alone + F.col("kids") == 0, 1).otherwise(0) + F.col("of_n_leaves")).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes") + F.col("of_saved")).alias("saved"),
    )
    d = written(d, "heavy")
    while not d.filter("up is not null").isEmpty():  # a node's sums reach twice as far down in each round
        below = d.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        above = d.select(F.col("key").alias("up"), F.col("up").alias("next"))
        more = d.join(below, "key", "left").join(above, "up", "left")
        past, d = d, written(more.select("key", F.col("next").alias("up"), "n_children", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "heavy")
        discard(past)
    return as_written(d.drop("up"), d)


def _digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv): the digest of each key's ids in their order, joined by commas."""

    def pieces(batches):
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1).to_pylist()
            if not ids:
                continue
            marks = pa.compute.not_equal(keys.slice(1), keys.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False) if len(ids) > 1 else np.empty(0, bool)
            bounds = [0, *(np.flatnonzero(marks) + 1).tolist(), len(ids)]
            cuts = [c for a, b in zip(bounds, bounds[1:], strict=False) for c in range(a, b, PIECE_IDS)]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(cuts, pa.int64())), pa.array([ids[a] for a in cuts], batch.column(1).type), pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)])],
                ["key", "first", "ids"],
            )

    def digest(batches):
        now, h = None, None
        for batch in batches:
            keys, digests = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        digests.append(h.hexdigest())
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends_sha256"])

    kind = dict(ends.dtypes)["conv"]
    rows = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(pieces, f"key binary, first {kind}, ids string")
    return rows.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard_rows: int | None = None, slices: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv, n, turn_hash, bytes (see `numbered`); conversations: conv, length, one row each,
    turnless ones too. A node is a distinct sequence of first turns, from the root of none; it is
    named by its smallest member and its depth. ``shard_rows``: rows below a node above which it is
    merged apart from the shards.

    * turnless conversations are members of the root and end there;
    * one conversation: nodes of one member each; none at all: no rows, no root either;
    * repeated and very long texts are known by their hashes; long conversations are chains.

    The result is a written table; the work tables are deleted.
    """
    most = SHARD_ROWS if shard_rows is None else shard_rows
    kind = dict(conversations.dtypes)["conv"]
    every = written(members(turns, conversations, slices), "members")
    nodes = every.groupBy("key").agg(
        F.min("conv").alias("conv"), F.first("n").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.sum("below").alias("weight"),
    )
    nodes = written(nodes, "nodes")
    shared = written(nodes.filter("n_convs > 1"), "shared")
    # the top of a light node's shard: the last light node on its way up
    small = shared.filter(F.col("weight") <= most)
    inner = small.join(small.select(F.col("key").alias("parent")), "parent", "left_semi").select(F.col("key").alias("node"), F.col("parent").alias("root"))
    tops = flattened(written(inner, "trees"))
    placed = small.join(tops.select(F.col("node").alias("key"), F.col("root").alias("shard")), "key", "left").withColumn("shard", F.coalesce("shard", "key"))
    told = "key binary, n_children long, n_leaves long, saved long"
    columns = ["shard", "key", "parent", "depth", "n_convs", "n_ends", "bytes"]
    light = written(placed.select(*columns).repartition("shard").sortWithinPartitions("shard").mapInArrow(_laid_out, told), "light")
    heavy = _heavy(shared, light.join(small.select("key", "parent", "n_convs"), "key"), most)
    values = light.unionByName(heavy)
    above = shared.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    digests = _digests(every.filter("ends"))
    out = nodes.join(values, "key", "left").join(above, "parent", "left").join(digests, "key", "left")
    out = out.select(
        F.col("conv").cast(kind).alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", 1 - F.col("n_ends")).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    out = written(out, "trie")
    discard(every, nodes, shared, tops, light, heavy)
    return out
