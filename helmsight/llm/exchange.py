"""What the whole corpus has for the keys of each block: up a tree of bounded fan-in and down again.

A block holds distinct keys, with values. Cut into hash ranges, the keys of up to FAN_IN
blocks meet in the nodes of the first level, one node a range, and their values are
combined. Where there are more blocks, nodes are children of a next level in turn, cut
into finer ranges, until one group holds all. There each distinct key is looked at once,
and the answers go down the same way, to each child in the order of its own keys.

A child sends a bounded number of fragments and a node has a bounded number of children,
so what is sent grows in proportion to the blocks (and with the tree's depth, their
logarithm), and the largest node does not grow at all: a key that every block holds comes
once from each child.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: children of a node, about, as they are dealt by hash
FAN_IN = 256
#: hash ranges that a block's keys are cut into
PARTS = 128

_ASKED = "child string, part long, keys binary, vals binary"
_ANSWERS = "child string, part long, answer binary, extra long"


class Codec:
    """How one kind of keys is packed, combined and answered. Keys come in an order in which part numbers do not fall."""

    def opened(self, keys: bytes, vals: bytes):
        raise NotImplementedError

    def closed(self, keys, vals) -> tuple[bytes, bytes]:
        raise NotImplementedError

    def part_of(self, keys, parts: int) -> np.ndarray:
        """Numbers of the hash ranges of keys; finer ranges lie inside coarser ones."""
        raise NotImplementedError

    def cut(self, keys, vals, start: int, end: int):
        raise NotImplementedError

    def united(self, children: list, parts: int):
        """Distinct keys in an order that depends on them alone, combined values, and where each child's keys are."""
        raise NotImplementedError

    def answer(self, keys, vals) -> tuple[list[np.ndarray], int]:
        """Answers for distinct keys of the whole corpus, and a number to be added up."""
        raise NotImplementedError

    def packed_answer(self, answers: list[np.ndarray]) -> bytes:
        raise NotImplementedError

    def opened_answer(self, data: bytes) -> list[np.ndarray]:
        raise NotImplementedError


def hash_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def fragments(codec: Codec, child: str, keys, vals, parts: int) -> pa.RecordBatch:
    """A child's keys in rows of `asked`."""
    part = codec.part_of(keys, parts)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(starts[1:], len(part))
    packs = [codec.closed(*codec.cut(keys, vals, a, b)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([child] * len(packs), pa.string()), pa.array(part[starts], pa.int64()), *(pa.array([p[k] for p in packs], pa.binary()) for k in (0, 1))],
        ["child", "part", "keys", "vals"],
    )


def answers_of(codec: Codec, rows: list[dict]) -> list[np.ndarray]:
    """A child's answers in the order of its keys, from its collected (part, answer)."""
    each = [codec.opened_answer(r["answer"]) for r in sorted(rows, key=lambda r: r["part"])]
    return [np.concatenate(x) for x in zip(*each, strict=True)]


def answered(asked: DataFrame, children: int, codec: Codec, parts: int = PARTS, fan_in: int = FAN_IN) -> DataFrame:
    """asked: child, part, keys, vals (see `fragments`), for so many children. Rows (child, part, answer, extra).

    Lazy, so ``asked`` should read written tables. Nodes of inner levels are written.
    """
    groups = max(1, math.ceil(children / fan_in))

    def opened(table: pa.Table) -> list:
        return [codec.opened(k.as_py(), v.as_py()) for k, v in zip(table.column("keys"), table.column("vals"), strict=True)]

    def down(table: pa.Table, positions: list[np.ndarray], answers: list[np.ndarray], extra: int) -> pa.Table:
        back = [codec.packed_answer([a[at] for a in answers]) for at in positions]
        n = table.num_rows
        return pa.table({"child": table.column("child"), "part": table.column("part"), "answer": pa.array(back, pa.binary()), "extra": pa.array([extra] + [0] * (n - 1), pa.int64())})

    if groups == 1:

        def top(table: pa.Table) -> pa.Table:
            keys, vals, positions = codec.united(opened(table), parts)
            answers, extra = codec.answer(keys, vals)
            return down(table, positions, answers, extra)

        return asked.groupBy("part").applyInArrow(top, _ANSWERS)

    finer = parts * fan_in
    dealt = asked.withColumn("node", F.concat_ws("/", F.pmod(F.xxhash64("child"), F.lit(groups)).cast("string"), F.col("part").cast("string")))

    def unite(table: pa.Table) -> pa.Table:
        keys, vals, _ = codec.united(opened(table), finer)
        k, v = codec.closed(keys, vals)
        return pa.table({"node": table.column("node").slice(0, 1), "keys": pa.array([k], pa.binary()), "vals": pa.array([v], pa.binary())})

    nodes = written(dealt.groupBy("node").applyInArrow(unite, "node string, keys binary, vals binary"), "nodes")

    def split(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield fragments(codec, node, *codec.opened(k, v), finer)

    above = answered(nodes.mapInArrow(split, _ASKED), groups, codec, finer, fan_in)
    of_node = written(above.groupBy(F.col("child").alias("node")).agg(F.collect_list(F.struct("part", "answer")).alias("answers"), F.sum("extra").alias("extra")), "answers")
    discard(nodes)

    def pass_down(table: pa.Table, of: pa.Table) -> pa.Table:
        _, _, positions = codec.united(opened(table), finer)
        row = of.to_pylist()[0]
        return down(table, positions, answers_of(codec, row["answers"]), row["extra"])

    return dealt.groupBy("node").cogroup(of_node.groupBy("node")).applyInArrow(pass_down, _ANSWERS)
