"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. Every text becomes its set of word shingles; texts with equal sets form a class,
   which is represented by its smallest id. Classes go on, copies do not.
2. A class has ``bands`` x ``rows`` MinHash samples. They fill the bands' keys, and
   they are folded into an odd sketch: each sample flips one bit of a bitmap, so the
   XOR of two bitmaps counts the samples in which the sets differ.
3. Stars: in each bucket all members are compared with its smallest one. Sketches
   discard pairs that are far below the threshold, full sets confirm the others.
4. Crossings: members of one bucket that the stars left in different components are
   compared in a task that takes the bucket: by sketch, then by what their sets have in
   common. A pair counts in the first band that it shares, and only pairs at the
   threshold leave the task, to be confirmed on full sets. Pairs inside one component
   could add nothing to the result, so they are passed over: a group of n near copies
   costs n comparisons and not n * n.
5. Large buckets (by rows or by shingles) whose members stay apart, such as pages of one
   template, are not compared all with all. Two sets at the threshold have one of their
   rarest shingles in common: of n shingles, the rarest n - ceil(similarity * n) + 1. So
   their members meet by each of these, which is exact. What two sets can share from the
   first of these on is bounded by how many shingles each has left in that order, so a
   shingle's rank tells which members can reach the threshold with any other one there:
   pages that begin with their own shingles and end with those of a template cannot, however
   many they are, and go no further. This takes a sort of the ranks, not pairs of members.
   Those that are left are compared in pairs of blocks by the same bound and by sketch.

With 40 bands of 5 rows a pair at 0.8 is in no common bucket with probability 1.3e-7.
The sketch lets through what lies within 5.5 standard deviations of the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, blocks, coded, discard, runs_of, word_hashes, written
from .components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: width of an odd sketch
SKETCH_BITS = 512
#: a bucket of more rows, or of more shingles in all, is large; a task holds two blocks of so many rows at most
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads them evenly (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct shingles of n words.

    Fewer words: the whole sequence is the one shingle. No words: the set is empty.
    """
    each = [WORD.findall(ascii_lower(t)) for t in texts]
    codes, terms = coded([w for ws in each for w in ws])
    flat = mixed(word_hashes(terms))[codes]
    joined = flat[: max(0, len(flat) - n + 1)].copy()
    for k in range(1, n):
        joined = joined * _ODD + flat[k : k + len(joined)]
    joined = mixed(joined)
    out, at = [], 0
    for ws in each:
        if len(ws) >= n:
            out.append(np.unique(joined[at : at + len(ws) - n + 1]))
        elif ws:
            short = np.uint64(len(ws))
            with np.errstate(over="ignore"):
                for h in flat[at : at + len(ws)]:
                    short = short * _ODD + h
            out.append(mixed(np.array([short ^ np.uint64(0x5851F42D4C957F2D)])))
        else:
            out.append(np.empty(0, np.uint64))
        at += len(ws)
    return out


def min_hashes(sets: list[np.ndarray], k: int, at_once: int = 40_000) -> np.ndarray:
    """MinHash samples of non-empty sets, one row each; sets are taken in runs that fit the processor's cache."""
    rng = np.random.default_rng(20240229)
    a = (rng.integers(0, 2**31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = (rng.integers(0, 2**31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    out = np.empty((len(sets), k), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= at_once):
            size += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first : last - 1]]))).astype(np.int64)
        low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        v, w = np.empty_like(low), np.empty_like(low)
        for i in range(k):
            np.multiply(low, a[i], out=v)
            np.multiply(high, b[i], out=w)
            np.add(v, w, out=v)
            out[first:last, i] = np.minimum.reduceat(v, starts)
        first = last
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(samples), bands)).copy()
    for r in range(rows):
        key = mixed(key * _ODD + samples[:, r::rows].astype(np.uint64))
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as SKETCH_BITS / 64 numbers a row."""
    n, k = samples.shape
    spot = mixed(samples.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    flat = spot.astype(np.int64) + np.arange(n, dtype=np.int64)[:, None] * SKETCH_BITS
    odd = (np.bincount(flat.ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def most_different(similarity: float, samples: int, sigmas: float = 5.5) -> int:
    """Population count of the XOR above which a pair can be taken to lie below the similarity.

    Of ``samples``, s * (1 - similarity) differ on average; each difference flips two
    bits, and m random flips leave n/2 * (1 - (1 - 2/n)^m) odd ones.
    """
    n, differ = SKETCH_BITS, samples * (1 - similarity)
    odd = lambda m: n / 2 * (1 - (1 - 2 / n) ** m)
    slope = (1 - 2 / n) ** (2 * differ)
    from_samples = 2 * math.sqrt(samples * similarity * (1 - similarity)) * slope
    p = odd(2 * differ) / n
    return math.ceil(odd(2 * differ) + sigmas * math.hypot(from_samples, math.sqrt(n * p * (1 - p))))


def sketch_distance(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def groups_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the columns ``by``, from sorted batches."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if rest is not None:
            t = pa.concat_tables([rest, t])
        marks = np.stack([t.column(c).to_numpy() for c in by])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), t.num_rows]
        for x, y in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield t.slice(x, y - x)
        rest = t.slice(bounds[-2])
    if rest is not None:
        yield rest


def _wide(group: pa.Table, name: str, kind: type, width: int) -> np.ndarray:
    return group.column(name).combine_chunks().flatten().to_numpy().view(kind).reshape(-1, width)


def may_reach(batches: Iterator[pa.RecordBatch], per_mille: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (key, n, nth), distinct, those that may reach the threshold with a row of their key, themselves included.

    nth is the rank of the shingle ``key`` in a set of n. Two sets of which it is the first shingle in common share at most
    the smaller of both n - nth + 1 shingles, and need per_mille / (10,000 + per_mille) of both sizes. So the other set must be
    small enough for this one's rest, and of sets that small the one with the most to spare decides.
    """
    for t in runs_of(batches, "key", most):
        key, n, nth = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "nth"))
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        starts = np.searchsorted(group, group)
        rest = (n - nth + 1) * (10_000 + per_mille)
        spare = rest - per_mille * n
        low, width = spare.min(), spare.max() - spare.min() + 1
        best = np.maximum.accumulate(spare - low + group * width)  # begins anew with each key
        top = np.clip(rest // per_mille - n, 0, n.max())
        at = np.searchsorted(group * (n.max() + 1) + n, group * (n.max() + 1) + top, side="right") - 1
        ok = (at >= starts) & (best[np.maximum(at, 0)] - group * width + low >= per_mille * n)
        yield from t.filter(pa.array(ok)).to_batches()


def close_pairs(group: pa.Table, far: int, per_mille: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers (i, several j > i) of different roots whose sketches and sizes allow the threshold."""
    n = group.num_rows
    root = group.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
    own = group.column("own").to_numpy()
    split = group.column("first")[0].as_py() != group.column("second")[0].as_py()
    sketch, size = _wide(group, "sketch", np.uint64, SKETCH_BITS // 64), group.column("n").to_numpy().astype(np.int64)
    left = size - group.column("nth").to_numpy() + 1 if "nth" in group.column_names else None
    for i in range(n - 1):
        rest = slice(i + 1, n)
        ok = root[rest] != root[i]
        if split:
            ok &= own[rest] != own[i]
        ok &= np.minimum(size[rest], size[i]) * 10_000 >= np.maximum(size[rest], size[i]) * per_mille
        if left is not None:  # the bound of `may_reach`
            ok &= np.minimum(left[rest], left[i]) * (10_000 + per_mille) >= (size[rest] + size[i]) * per_mille
        js = np.flatnonzero(ok) + i + 1
        if len(js):
            js = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1) <= far]
        if len(js):
            yield i, js


def crossing_pairs(group: pa.Table, far: int, per_mille: int) -> tuple[list[int], list[int]]:
    """Row numbers of the pairs of a bucket that may reach the threshold.

    Pairs of one root are left out, and pairs that share an earlier band. What two sets
    have in common is counted on the upper halves of their hashes, which is too low only
    where hashes in common agree there. Each set has at least as many more hashes than
    upper halves, so the smaller of both differences is added and no pair is lost.
    """
    band = group.column("band")[0].as_py()
    size = group.column("n").to_numpy().astype(np.int64)
    keys = _wide(group, "keys", np.int64, len(group.column("keys")[0]))
    small = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("small")]
    lengths = np.array([len(x) for x in small], np.int64)
    merged, starts = size - lengths, np.concatenate(([0], np.cumsum(lengths)))
    flat = here = None
    a, b = [], []
    for i, js in close_pairs(group, far, per_mille):
        js = js[(keys[js] == keys[i]).argmax(axis=1) == band]
        if len(js) > 16:
            if flat is None:  # the bucket's hashes, numbered
                flat = np.unique(np.concatenate(small), return_inverse=True)[1].astype(np.int32)
                here = np.zeros(int(flat.max()) + 1, np.uint8)
            here[flat[starts[i] : starts[i + 1]]] = 1
            common = np.add.reduceat(here[flat[starts[js[0]] :]], starts[js[0] : -1] - starts[js[0]], dtype=np.int64)[js - js[0]]
            here[flat[starts[i] : starts[i + 1]]] = 0
        else:
            common = np.array([len(np.intersect1d(small[i], small[j], assume_unique=True)) for j in js.tolist()], np.int64)
        common += np.minimum(merged[i], merged[js])
        got = js[common * 10_000 >= (size[i] + size[js] - common) * per_mille]
        a += [i] * len(got)
        b += got.tolist()
    return a, b


def with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the columns of groups, which has one row for some of the keys in the column ``key``.

    The other side's key is computed anew, which keeps the join from taking over the
    partitioning of the aggregation that made it: both sides get exchanges of their own,
    so adaptive execution can split a hot key.
    """
    named = groups.select(F.col("key").bitwiseXOR(F.lit(1)).alias("_key"), *(c for c in groups.columns if c != "key"))
    return rows.join(named, F.col("key").bitwiseXOR(F.lit(1)) == F.col("_key")).drop("_key")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    bands: int = 40,
    rows: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id, kept.

    Documents are linked when their shingle sets have a Jaccard similarity of at least
    ``similarity`` (to four decimals); component_id is the smallest id reachable.

    * null, empty and blank texts have an empty set, are linked with nothing and stay;
    * null id: cannot be named, so such a row links nothing, has a null component and stays;
    * repeated rows: one document, reported as often as it occurs (all kept if its id is the component's);
    * one id with several texts: its sets are all linked through the id;
    * very long texts are one row of their own block; an empty table gives no rows;
    * other columns are ignored, whatever their names.

    The result is a written table; the work tables are deleted.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)
    per_mille = round(similarity * 10_000)
    far = most_different(similarity, bands * rows)

    def features(batches):
        for ids, texts in blocks(batches, 1_000_000):
            sets = shingle_sets(texts, shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            marks: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            sketches: list = [None] * len(sets)
            if full:
                samples = min_hashes([sets[i] for i in full], bands * rows)
                k, o = band_keys(samples, bands, rows), odd_sketches(samples)
                for j, i in enumerate(full):
                    marks[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    keys[i], sketches[i] = k[j], o[j]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, arrow_id),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(marks, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["id", "n", "mark", "keys", "sketch"],
            )

    def sets_of(batches):
        for ids, texts in blocks(batches, 1_000_000):
            sets = shingle_sets(texts, shingle)
            small = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_id), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(small, pa.binary())], ["id", "set", "small"]
            )

    def of_pairs(group, a, b):
        ids = group.column("id")
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())).combine_chunks() for x in (a, b)], ["a", "b"])

    def cross(batches):
        for group in groups_of(batches, ["key", "first", "second"]):
            a, b = crossing_pairs(group, far, per_mille)
            if a:
                yield of_pairs(group, a, b)

    def cross_by_sketch(batches):
        for group in groups_of(batches, ["key", "first", "second"]):
            for i, js in close_pairs(group, far, per_mille):
                yield of_pairs(group, [i] * len(js), js)

    id_sql = kind.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    feats = written(texts.mapInArrow(features, f"id {id_sql}, n long, mark binary, keys array<long>, sketch array<long>"), "features")
    # rows of one mark have equal keys and sketches, so any of them serves
    classes = written(
        feats.filter("mark is not null and id is not null")
        .groupBy("mark")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")),
        "classes",
    )
    keyed = classes.select("id", "n", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    shared = written(with_group(keyed, buckets), "buckets")

    sketches = classes.select("id", "sketch")
    side = lambda df, name, column: df.select(F.col("id").alias(name), F.col(column).alias(f"{column}_{name}"))
    close = sketch_distance(F.col("sketch_a"), F.col("sketch_b")) <= far
    stars = shared.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    stars = stars.join(side(sketches, "b", "sketch"), "b").join(side(sketches, "a", "sketch"), "a").filter(close).select("a", "b")

    full_sets = written(texts.join(shared.select("id").distinct(), "id").select("id", "text").mapInArrow(sets_of, f"id {id_sql}, set array<long>, small binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(full_sets, "b", "set"), "b").join(side(full_sets, "a", "set"), "a")
        common = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - common
        return both.filter(common.cast("long") * 10_000 >= union.cast("long") * per_mille).select("a", "b")

    first_roots = components(confirmed(stars))  # each (node, root) row is as good as the links that made it
    placed = shared.join(first_roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "band", "id", "n", F.coalesce("root", "id").alias("root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass"))
    is_large = (F.col("size") > BLOCK_ROWS) | (F.col("mass") > BLOCK_SHINGLES)
    open_rows = written(with_group(placed, open_keys.filter("r0 < r1").select("key", is_large.alias("large"))), "open")
    whole = {"own": F.lit(0), "first": F.lit(0), "second": F.lit(0)}
    known = classes.select("id", "keys", "sketch").join(full_sets.select("id", "small"), "id")
    grouped = open_rows.filter("NOT large").join(known, "id").withColumns(whole).select("key", "first", "second", "own", "band", "id", "root", "n", "sketch", "keys", "small")
    crossing = grouped.repartition("key").sortWithinPartitions("key").mapInArrow(cross, f"a {id_sql}, b {id_sql}")

    def met_by_rarest() -> DataFrame:
        """Pairs (a, b) of members of large buckets, which meet by their rarest shingles. A row a shingle is written once."""
        apart = open_rows.filter("large").select("id", "root", "n").distinct()
        tokens = full_sets.select("id", "set").join(apart, "id").select("id", "root", "n", F.explode("set").alias("key"))
        ranked = with_group(tokens, tokens.groupBy("key").agg(F.count(F.lit(1)).alias("held")))
        nth = F.row_number().over(Window.partitionBy("id").orderBy("held", "key"))
        needed = F.col("n") - F.ceil(F.col("n") * per_mille / F.lit(10_000)) + 1
        rare = ranked.withColumn("nth", nth).filter((F.col("nth") <= needed) & (F.col("held") > 1)).select("key", "id", "root", "n", "nth")
        rare = written(rare, "rare")
        ranks = rare.select("key", "n", "nth").distinct().repartition("key").sortWithinPartitions("key", "n")
        able = ranks.mapInArrow(lambda batches: may_reach(batches, per_mille), "key long, n long, nth int")
        able = able.select(F.col("key").alias("_k"), F.col("n").alias("_n"), F.col("nth").alias("_nth"))
        some = rare.join(able, (F.col("key") == F.col("_k")) & (F.col("n") == F.col("_n")) & (F.col("nth") == F.col("_nth")), "left_semi")
        met = some.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).filter("r0 < r1")
        met = with_group(some, met.select("key", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks")))
        met = met.join(sketches, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "id", "root", "n", "nth", "sketch")
        met = met.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second").mapInArrow(cross_by_sketch, f"a {id_sql}, b {id_sql}")
        met = written(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "met")
        discard(rare)
        return met

    rarest = None if open_rows.filter("large").isEmpty() else met_by_rarest()
    more = confirmed(crossing if rarest is None else crossing.union(rarest))
    # an id that comes with several sets ties them together
    marks = feats.filter("mark is not null and id is not null").select("id", "mark")
    by_mark = classes.select("mark", F.col("id").alias("class"))
    own = written(marks.join(by_mark, "mark").select("id", "class").distinct(), "members")
    several = own.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("a")).filter("a > b").select("id")
    tied = own.join(several, "id").select(F.col("class").alias("a"), F.col("id").alias("b"))
    roots = components(first_roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more).union(tied))

    member = own.groupBy("id").agg(F.min("class").alias("class"))
    found = feats.select("id", "n").join(member, "id", "left").join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    component = F.coalesce("root", "class", "id")
    found = found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
    out = written(found, "near")
    discard(feats, classes, shared, full_sets, first_roots, open_rows, own, roots, *([] if rarest is None else [rarest]))
    return out
