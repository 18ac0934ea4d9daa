"""Near-duplicate vectors by collision-counting projections.

1. Equal vectors of a label form a class; classes go on with the number of ids that they stand for.
2. Every unit vector is projected on to random lines. Sums of whole numbers make the
   projections, so they are the same bit for bit wherever they are worked out.
3. Groups: in each, some lines cut the vectors into cells and one more line sorts a cell. Two
   vectors meet in a group if they share the cell and each lies in the window that is centred
   on the other along the sorted line. Cells get deeper with the logarithm of the number of
   vectors, and there are as many groups as pairs at the threshold need to meet in at least
   one of them but for a share of MISS.
4. Who meets has its collisions counted: the lines on which the other lies in the window. Pairs
   with fewer than a pair at the threshold has, but for a share of MISS, are let go; the cosine
   in double precision verifies the others. A pair counts in the first group in which it meets.
5. Pairs stay in their task: out come each vector's number of links there and its root among
   those linked there.
6. Balls: vectors within half of the threshold's angle around one of them are all linked with
   each other, which needs no comparison. Members of one ball are told each other's number and
   are never compared, so a hot group of near copies costs what its number is, not its square.
   Cells with more than BLOCK_ROWS vectors are compared in pairs of blocks, without those of
   one ball among themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import components
from .near_dedup import groups_of, mixed, with_group

#: lines on which collisions are counted; share of pairs at the threshold that a step may miss
COUNTED, MISS = 32, 5e-4
#: half a window, half a sorted line's window and a cell's width, by the standard deviation of what pairs at the threshold differ by
WINDOW, SORTED_WINDOW, CELL = 2.0, 3.0, 6.0
#: share of unrelated pairs that share a cell on one line; vectors that a cell should hold; vectors of a block
CELL_SHARE, CELL_ROWS, BLOCK_ROWS = 0.55, 4096, 4096
#: lines of the cells whose members are tried as a ball
BALL_LINES = 8
#: units of a unit vector's components, of lines, and of projections
_UNIT, _LINE, _STEP = 1 << 14, 1 << 8, 1 << 11
_PER_ONE = _UNIT * _LINE // _STEP


def _normal(x: float) -> float:
    """Share of a normal distribution within x standard deviations."""
    return math.erf(x / math.sqrt(2))


class Plan:
    """What projections are made for so many vectors (of the largest label) and a threshold."""

    def __init__(self, threshold: float, vectors: int, cell_rows: int = CELL_ROWS):
        self.threshold = threshold
        spread = math.sqrt(2 * (1 - threshold))  # of what two vectors at the threshold differ by on a line
        step = spread * _PER_ONE
        self.window, self.sorted_window, self.width = round(WINDOW * step), round(SORTED_WINDOW * step), round(CELL * step)
        self.depth = max(0, math.ceil(math.log(max(1, vectors) / cell_rows) / -math.log(CELL_SHARE)))
        # a cell parts two points at distance z with probability z / width
        stay = 1 - math.sqrt(2 / math.pi) / CELL
        meet = stay**self.depth * _normal(SORTED_WINDOW)
        self.groups = max(2, math.ceil(math.log(MISS) / math.log(1 - meet)))
        self.lines = max(COUNTED, self.groups * (self.depth + 1), BALL_LINES)
        # the largest count that pairs at the threshold reach but for MISS
        p, short, self.least = _normal(WINDOW), 0.0, 0
        while (short := short + math.comb(COUNTED, self.least) * p**self.least * (1 - p) ** (COUNTED - self.least)) < MISS:
            self.least += 1

    def projections(self, units: np.ndarray) -> np.ndarray:
        """Whole numbers, a row for each of the vectors (as whole numbers too)."""
        lines = np.rint(np.random.default_rng(1000 + units.shape[1]).standard_normal((units.shape[1], self.lines)) * _LINE)
        return np.floor_divide(units.astype(np.float64) @ lines, _STEP).astype(np.int16)

    def cells(self, at: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The cell of each row (at: projections; label: a number) in each group."""
        offsets = np.random.default_rng(7).integers(0, self.width, self.lines)
        key = np.empty((len(at), self.groups), np.uint64)
        for g in range(self.groups):
            k = mixed(label + np.uint64(g + 1))
            for line in range(g * (self.depth + 1), g * (self.depth + 1) + self.depth):
                k = mixed(k ^ ((at[:, line].astype(np.int64) + offsets[line]) // self.width).astype(np.uint64))
            key[:, g] = k
        return key.view(np.int64)

    def ball_cells(self, at: np.ndarray, label: np.ndarray) -> np.ndarray:
        k = mixed(label)
        for line in range(BALL_LINES):
            k = mixed(k ^ (at[:, line].astype(np.int64) // self.width).astype(np.uint64))
        return k.view(np.int64)

    def sorted_line(self, group: int) -> int:
        return group * (self.depth + 1) + self.depth


def unit_rows(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow and no underflow in the squares
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of equal length from a binary column."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (a forest's roots) after joining the rows a with b; roots are the smallest rows."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def compared(t: pa.Table, plan: Plan, kind) -> pa.RecordBatch | None:
    """What a cell, or a pair of its blocks, links: mark, the number of ids linked with it here, its root here."""
    n = t.num_rows
    column = lambda name: t.column(name).combine_chunks()
    group = t.column("group")[0].as_py()
    q = _matrix(column("q"), np.int16)
    at = plan.projections(q)
    along = at[:, plan.sorted_line(group)].astype(np.int32)
    order = np.argsort(along, kind="stable")
    at, along = at[order], along[order]
    ball = column("ball").dictionary_encode().indices.to_numpy()[order]
    own, weight = column("own").to_numpy()[order], column("weight").to_numpy()[order]
    two = t.column("first")[0].as_py() != t.column("second")[0].as_py()
    units = unit_rows(_matrix(column("raw"), kind).astype(np.float64)[order])
    counted, cells = np.ascontiguousarray(at[:, :COUNTED].T), None
    links, root = np.zeros(n, np.int64), np.arange(n)
    last = np.searchsorted(along, along + plan.sorted_window, side="right")
    for low in range(0, n, 256):
        high = min(n, low + 256)
        rest = slice(low, int(last[high - 1]))
        ok = ball[low:high, None] != ball[None, rest]
        if two:
            ok &= own[low:high, None] != own[None, rest]
        ok &= (np.arange(rest.start, rest.stop)[None, :] > np.arange(low, high)[:, None]) & (np.arange(rest.start, rest.stop)[None, :] < last[low:high, None])
        if not ok.any():
            continue
        hits = np.zeros(ok.shape, np.uint8)
        for line in counted:
            hits += np.abs(line[low:high, None] - line[None, rest]) <= plan.window
        i, j = np.nonzero(ok & (hits >= plan.least))
        i, j = i + low, j + low
        for part in np.split(np.arange(len(i)), range(100_000, len(i), 100_000)):
            a, b = i[part], j[part]
            near = (units[a] * units[b]).sum(axis=1) >= plan.threshold
            a, b = a[near], b[near]
            if group and len(a):
                if cells is None:
                    cells = plan.cells(at, np.zeros(n, np.uint64))
                met = np.zeros(len(a), bool)
                for g in range(group):
                    line = at[:, plan.sorted_line(g)].astype(np.int32)
                    met |= (cells[a, g] == cells[b, g]) & (np.abs(line[a] - line[b]) <= plan.sorted_window)
                a, b = a[~met], b[~met]
            if len(a):
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                root = merged(root, a, b)
    found = np.flatnonzero(links)
    if not len(found):
        return None
    marks = column("mark").take(pa.array(order))
    return pa.RecordBatch.from_arrays(
        [marks.take(pa.array(found)), pa.array(links[found], pa.int64()), marks.take(pa.array(root[found]))], ["mark", "links", "root"]
    )


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row: id_col, n_links, component_id, kept.

    Vectors of one label are linked when their cosine in double precision is at least ``threshold``.
    n_links: other vectors linked directly; component_id: the smallest id reachable by links.

    * vectors that are null, empty, zero, or hold null or non-finite components, and those without a
      label, link with nothing and stay; so do vectors of different lengths;
    * null id: cannot be named, so such a row links nothing, has a null component and stays;
    * repeated rows: one vector, reported as often as it occurs; equal vectors of several ids are linked;
    * one id with several vectors: each has its own links, and they are tied through the id;
    * an empty table gives no rows; other columns are ignored, whatever their names.

    Recall is below 1: pairs just at the threshold are missed with a probability of about 2 * MISS, closer
    ones less; none below the threshold is linked. The result is a written table; the work tables are deleted.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = rows.schema[id_col].dataType
    id_sql = id_kind.simpleString()
    raw_kind = np.float32 if rows.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64

    def features(batches):
        for batch in batches:
            ids, vectors, labels = batch.columns
            flat = vectors.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = pa.compute.list_value_length(vectors).fill_null(0).to_numpy()
            ends = np.cumsum(lengths)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values)))) if len(values) else np.zeros(1, int)
            marks: list = [None] * len(ids)
            raws: list = [None] * len(ids)
            units: list = [None] * len(ids)
            for i, (key, label, low, high) in enumerate(zip(ids, labels, (ends - lengths).tolist(), ends.tolist(), strict=True)):
                if not key.is_valid or not label.is_valid or low == high or bad[high] != bad[low]:
                    continue
                v = values[low:high] + 0.0  # no -0.0
                top = np.abs(v).max()
                if not top:
                    continue
                unit = v / top  # no overflow and no underflow in the squares
                unit = unit / math.sqrt(float((unit * unit).sum()))
                raws[i] = v.astype(raw_kind).tobytes()
                units[i] = np.rint(unit * _UNIT).astype(np.int16).tobytes()
                marks[i] = hashlib.blake2b(f"{label.as_py()} ".encode() + raws[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [ids.cast(arrow_id), labels.cast(pa.string()), *(pa.array(x, pa.binary()) for x in (marks, raws, units))], ["id", "label", "mark", "raw", "q"]
            )

    arrow_id = to_arrow_type(id_kind)
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    feats = written(given.mapInArrow(features, f"id {id_sql}, label string, mark binary, raw binary, q binary"), "vectors")
    usable = feats.filter("mark is not null")
    classes = usable.groupBy("mark").agg(F.first("label").alias("label"), F.first("raw").alias("raw"), F.first("q").alias("q"), F.count_distinct("id").alias("weight"))
    classes = written(classes, "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    plan = Plan(threshold, most, cell_rows)

    def keyed(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sizes = pa.compute.binary_length(t.column("q")).to_numpy()
            for size in np.unique(sizes):
                some = t.take(pa.array(np.flatnonzero(sizes == size)))
                names = some.column("label").to_pylist()
                label = np.array([int.from_bytes(hashlib.blake2b(f"{size} {x}".encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
                at = plan.projections(_matrix(some.column("q").combine_chunks(), np.int16))
                keys = plan.cells(at, label)
                some = some.select(["mark", "weight", "raw", "q"]).append_column("cell", pa.array(plan.ball_cells(at, label)))
                yield from some.append_column("keys", pa.array(list(keys), pa.list_(pa.int64()))).combine_chunks().to_batches()

    thin = written(classes.select("mark", "weight", "raw", "q", "label").mapInArrow(keyed, "mark binary, weight long, raw binary, q binary, cell long, keys array<long>"), "projected")

    # balls: the members of a cell around its smallest mark
    centres = thin.groupBy(F.col("cell").alias("key")).agg(F.min(F.struct("mark", "raw")).alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    half = math.cos(math.acos(min(1.0, max(-1.0, threshold))) / 2) + 1e-9

    def inside(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sizes = pa.compute.binary_length(t.column("raw")).to_numpy()
            ok = np.zeros(t.num_rows, bool)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                a, b = (unit_rows(_matrix(t.column(c).combine_chunks().take(pa.array(at)), raw_kind).astype(np.float64)) for c in ("raw", "centre_raw"))
                ok[at] = (a * b).sum(axis=1) >= half
            yield from t.select(["mark", "ball", "weight"]).filter(pa.array(ok)).to_batches()

    tried = with_group(thin.withColumnRenamed("cell", "key").select("key", "mark", "raw", "weight"), centres.select("key", "centre"))
    tried = tried.select("mark", F.col("centre.mark").alias("ball"), "weight", "raw", F.col("centre.raw").alias("centre_raw"))
    balls = written(tried.mapInArrow(inside, "mark binary, ball binary, weight long"), "balls")
    sums = balls.groupBy("ball").agg(F.sum("weight").alias("in_ball"))
    placed = written(thin.drop("cell").join(balls.select("mark", "ball"), "mark", "left").withColumn("ball", F.coalesce("ball", "mark")), "placed")

    # who meets whom: cells, and pairs of blocks of large ones
    meet = placed.select("mark", "ball", F.posexplode("keys").alias("group", "key"))
    sizes = meet.groupBy("key", "ball").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") > block_rows
    blocks_of = lambda n: F.ceil(n / block_rows).cast("int")
    cells = sizes.groupBy("key").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("balls"), F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)).alias("others"),
        F.collect_list(F.when(large, F.struct("ball", "n"))).alias("big"),  # at most n / block_rows
    ).filter("balls > 1")
    # a cell's blocks: those of its smaller balls, then those of each large one
    blocks = F.concat(F.array_repeat(F.lit(b""), blocks_of(F.col("others"))), F.flatten(F.transform("big", lambda b: F.array_repeat(b["ball"], blocks_of(b["n"])))))
    cells = cells.select("key", F.when(F.col("n") > block_rows, blocks).alias("blocks"))
    met = placed.select("mark", "ball", "weight", "raw", "q", F.posexplode("keys").alias("group", "key"))
    met = with_group(met, cells)
    name = F.when(F.array_contains("blocks", F.col("ball")), F.col("ball")).otherwise(F.lit(b""))
    met = met.withColumn("_name", name)
    mine = F.size(F.filter("blocks", lambda b: b == F.col("_name")))
    own = F.coalesce((F.array_position("blocks", F.col("_name")) - 1 + F.pmod(F.xxhash64("mark"), mine)).cast("int"), F.lit(0))
    met = met.withColumn("own", own)
    partner = F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), lambda i: (F.get("blocks", i) == F.lit(b"")) | (F.get("blocks", i) != F.col("_name")))
    met = met.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(partner)))
    met = met.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "group", "mark", "ball", "weight", "raw", "q")

    def cross(batches):
        for t in groups_of(batches, ["key", "first", "second"]):
            if t.num_rows > 1 and (found := compared(t, plan, raw_kind)) is not None:
                yield found

    met = met.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
    links = written(met.mapInArrow(cross, "mark binary, links long, root binary"), "links")

    marked = usable.select("id", "mark").distinct()
    several = marked.groupBy("id").agg(F.min("mark").alias("b"), F.max("mark").alias("a")).filter("a > b").select("id", "b")
    tied = marked.join(several, "id").filter("mark <> b").select(F.col("mark").alias("a"), "b")
    edges = balls.filter("mark <> ball").select(F.col("mark").alias("a"), F.col("ball").alias("b"))
    roots = components(edges.union(links.select(F.col("mark").alias("a"), F.col("root").alias("b"))).union(tied))
    known = placed.select("mark", "ball", "weight").join(sums, "ball", "left").join(links.groupBy("mark").agg(F.sum("links").alias("links")), "mark", "left")
    known = known.join(roots.select(F.col("node").alias("mark"), "root"), "mark", "left")
    known = written(known.select("mark", (F.coalesce("in_ball", "weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "mark").alias("root")), "known")
    least = usable.groupBy("mark").agg(F.min("id").alias("id")).join(known.select("mark", "root"), "mark").groupBy("root").agg(F.min("id").alias("component"))
    known_ids = known.join(least, "root").select("mark", "n_links", "component")
    # rows that link with nothing have a key of their own, so that they do not meet as nulls in one task
    key = F.coalesce(F.hex("mark"), F.concat(F.lit("none "), F.coalesce(F.col("id").cast("string"), F.expr("uuid()"))))
    out = feats.select("id", key.alias("_key")).join(known_ids.select(F.hex("mark").alias("_key"), "n_links", "component"), "_key", "left")
    component = F.coalesce("component", "id")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    out = written(out, "near-vectors")
    discard(feats, classes, thin, balls, placed, links, roots, known)
    return out
