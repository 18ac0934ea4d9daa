"""Running values along each key's log: one window, or a prefix scan over even slices.

`running` adds running columns in the order of a key's log. A log that is small enough is
one window: one exchange and one sort for all columns. `sliced` prepares a table of which
one key may hold a large part: a bounded sample of the keys and orders gives cuts that
divide all rows evenly, wherever they fall, so only keys with many rows are cut. Windows
then go over (key, slice). What a slice hands on is combined on the map side into one row,
of which there are as many as cuts: they come to the driver, so that a round which builds on
another one reads its values and not its plan, and are joined by broadcast. Both ways give
the same values; nothing is written, and rows move once for any number of rounds over the
same slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: what one task may hold of a log, and the size of a slice beyond that, in bytes as the optimizer estimates them
TASK_BYTES, SLICE_BYTES = 256_000_000, 64_000_000
#: bounds of the number of cuts, which are broadcast, and of the sampled rows for each, which come to the driver
MOST_SLICES, SAMPLED = 4096, 64
_SLICE, _IS_CUT = "_slice", "_is_cut"
_HASHES = 1 << 40


@dataclass(frozen=True)
class Last:
    """The last non-null value of a column so far; before the current row only, where `before`."""

    column: str
    before: bool = False


@dataclass(frozen=True)
class Sum:
    """The sum of a numeric column so far, null values counting as 0."""

    column: str


#: bytes of a row where the optimizer does not know the size of a table, which is then counted
_ROW_BYTES = 100


def estimated_bytes(df: DataFrame) -> int:
    """What df takes by the sizes of the tables that it is made of. Runs no job, but for tables made of RDDs, of which nothing is known."""
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.count() * _ROW_BYTES


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """df made ready for `running` over these keys in this order, cut into ``slices`` even runs of rows.

    None: as many as its size asks for, and none at all where a task can take the whole of it.
    """
    if slices is None:
        size = estimated_bytes(df)
        slices = 1 if size <= TASK_BYTES else min(MOST_SLICES, size // SLICE_BYTES)
    cuts = _cuts(df, keys, order, slices) if slices > 1 else []
    if not cuts:
        return df
    at = T.StructType([df.schema[c] for c in order])
    fields = [T.StructField(f"_of_{c}", df.schema[c].dataType) for c in keys]
    table = df.sparkSession.createDataFrame(cuts, T.StructType([*fields, T.StructField("_cuts", T.ArrayType(at))]))
    same = [df[c].eqNullSafe(table[f"_of_{c}"]) for c in keys]
    known = df.join(F.broadcast(table), same, "left")  # MOST_SLICES cuts at most
    held, here = F.col("_cuts"), F.struct(*order)
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(len(c[-1]) for c in cuts).bit_length()))))
    # the number of cuts at or before the row, by halving
    found = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size(held)) & (F.get(held, n + step - 1) <= here), n + step).otherwise(n))
    return known.select(*(df[c] for c in df.columns), F.when(held.isNotNull(), found).otherwise(0).alias(_SLICE), held.isNotNull().alias(_IS_CUT))


def _cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int) -> list[tuple]:
    """Rows (*key, first rows of its later slices): quantiles of a sample of at most SAMPLED rows a slice."""
    thin = df.select(*keys, *order).withColumn("_hash", F.pmod(F.xxhash64(*keys, *order), F.lit(_HASHES)))
    rows = max(1, estimated_bytes(thin) // 64)
    share = min(_HASHES, _HASHES * SAMPLED * slices // rows * 4 + 1)  # estimates are rough: the limit keeps the bound
    picked = thin.filter(F.col("_hash") < share).orderBy("_hash").limit(SAMPLED * slices).drop("_hash").collect()
    nulls_first = lambda row: tuple((x is not None, x if x is not None else 0) for x in row)
    ranked = sorted(map(tuple, picked), key=nulls_first)
    firsts = dict.fromkeys(ranked[i * len(ranked) // slices] for i in range(1, slices)) if ranked else {}
    by_key: dict[tuple, list[tuple]] = {}
    for row in firsts:
        by_key.setdefault(row[: len(keys)], []).append(row[len(keys) :])
    return [(*key, starts) for key, starts in by_key.items()]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], **wanted: Last | Sum) -> DataFrame:
    """df with a column for each of ``wanted``. A table from `sliced` is scanned slice by slice and stays sliced."""
    cut = _SLICE in df.columns
    inside = [*keys, _SLICE] if cut else list(keys)
    window = W.partitionBy(*inside).orderBy(*order)
    start = W.unboundedPreceding

    def local(kind: Last | Sum) -> Column:
        if isinstance(kind, Sum):
            return F.coalesce(F.sum(kind.column).over(window.rowsBetween(start, 0)), F.lit(0))
        return F.last(kind.column, ignorenulls=True).over(window.rowsBetween(start, -1 if kind.before else 0))

    out = df.withColumns({name: local(kind) for name, kind in wanted.items()})
    if not cut:
        return out

    def handed_on(kind: Last | Sum) -> Column:
        if isinstance(kind, Sum):
            return F.sum(kind.column)
        said = F.col(kind.column).isNotNull()
        return F.max_by(F.when(said, F.col(kind.column)), F.when(said, F.struct(*order)))

    ends = df.filter(_IS_CUT).groupBy(*inside).agg(*(handed_on(kind).alias(f"_{name}") for name, kind in wanted.items()))
    earlier = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(start, -1)
    before = lambda name, kind: F.sum(f"_{name}").over(earlier) if isinstance(kind, Sum) else F.last(f"_{name}", ignorenulls=True).over(earlier)
    carried = ends.select(*(F.col(c).alias(f"_of_{c}") for c in inside), *(before(name, kind).alias(f"_before_{name}") for name, kind in wanted.items()))
    found = carried.filter(f"_of_{_SLICE} > 0").collect()  # a row for each cut at most
    carried = F.broadcast(df.sparkSession.createDataFrame(found, carried.schema).coalesce(1))
    joined = out.join(carried, [out[c].eqNullSafe(carried[f"_of_{c}"]) for c in inside], "left")
    merged = {
        name: F.col(name) + F.coalesce(f"_before_{name}", F.lit(0)) if isinstance(kind, Sum) else F.coalesce(name, f"_before_{name}")
        for name, kind in wanted.items()
    }
    return joined.select(*df.columns, *(c.alias(name) for name, c in merged.items()))


def whole(df: DataFrame) -> DataFrame:
    """df without what `sliced` added."""
    return df.drop(_SLICE, _IS_CUT)
