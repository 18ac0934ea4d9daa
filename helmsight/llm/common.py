"""Shared helpers of the corpus operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..functions.shared import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def ascii_lower(text: str) -> str:
    """The text with A-Z lower-cased and nothing else. On UTF-8 bytes, where it is some twenty times faster."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).decode("utf-8", "surrogatepass")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/helmsight-{name}-{uuid.uuid4().hex}"


#: Spark's switch for deleting a query's exchanges from the executors' disks as soon as the query has run
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SWITCHING = threading.Lock()


@contextmanager
def _cleaning_up(spark: SparkSession):
    """The switch is on from the first of the session's writes that overlap to the last one, and then as it was."""
    with _SWITCHING:
        count, before = getattr(spark, "_helmsight_writes", (0, None))
        if not count:
            before = spark.conf.get(_CLEAN_UP, None)
            spark.conf.set(_CLEAN_UP, "true")
        spark._helmsight_writes = count + 1, before
    try:
        yield
    finally:
        with _SWITCHING:
            count, before = spark._helmsight_writes
            spark._helmsight_writes = count - 1, before
            if count == 1:
                spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its
    lineage: a lost executor costs the tasks that ran on it and no earlier stage.
    The exchanges that made the table are not needed again and are deleted."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with _cleaning_up(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helmsight_path = path
    return out


def as_written(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which is columns of a written table, as what `discard` takes."""
    df._helmsight_path = table._helmsight_path
    return df


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` made, once all that was made from them is written too."""
    for df in tables:
        delete(df.sparkSession, df._helmsight_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def coded(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """Numbers of the words in the order of first sight, and the distinct words.

    Arrow compares whole strings; pandas' factorize would end them at a NUL.
    """
    d = pa.array(words, pa.string()).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_pylist()


def word_hashes(terms: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same on every machine."""
    return pd.util.hash_array(np.array(terms, dtype=object), categorize=False) if terms else np.empty(0, np.uint64)


def packed(x: np.ndarray) -> bytes:
    """Numbers with all first bytes together, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def runs_of(batches: Iterable[pa.RecordBatch], by: str, most: int) -> Iterator[pa.Table]:
    """Rows sorted by a column, in tables of about so many rows that never cut a run of equal ones."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows >= most:
            column = rest.column(by)
            changes = np.flatnonzero(pc.not_equal(column.slice(1), column.slice(0, rest.num_rows - 1)).to_numpy())
            if len(changes):
                cut = int(changes[-1]) + 1
                yield rest.slice(0, cut)
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def blocks(batches: Iterable[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Cut Arrow batches of (id, text) into runs of rows of about so many characters.

    Null texts come as empty ones. A single text longer than that is a block by itself.
    """
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if ids and size + len(text) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += len(text)
        if ids:
            yield ids, texts
