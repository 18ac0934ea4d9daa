"""A training-data pipeline: toxic documents, exact copies, near copies and documents with
benchmark passages go; what stays is encoded.

STAGES are (name, function); each function takes (spark, docs, sf_dir). Stages drop
documents by an anti-join with what to drop. That is written first, so that its own size
tells how to join: little is broadcast and the texts stay where they are, and only where it
is much are both sides shuffled. Where ids are null or repeated, which a count of the ids tells, ids do
not name rows, and decisions go by the id with the text: a row goes for what its own text
is, and of exact copies one row stays, also of repeated rows and of rows without an id.
Without an id, null texts and empty ones are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsight.llm.common import discard, written
from helmsight.llm.decontaminate import contamination
from helmsight.llm.exact_dedup import exact_dedup, normalised
from helmsight.llm.near_dedup import near_duplicates
from helmsight.llm.queries import table, tokenizer_path
from helmsight.llm.sentencepiece_np import encode_documents
from helmsight.llm.toxicity import reject_toxic, train


def ids_name_rows(docs: DataFrame) -> bool:
    """Whether no id is null or repeated. Reads the ids only."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1").isEmpty()


def row_name() -> Column:
    """A number for the id with the text: in the order of ids, with null as the last, then 18 digits of a hash of the text."""
    last = "10000000000000000000"  # above all 64-bit ids
    text = F.pmod(F.xxhash64("text"), F.lit(10**18)).cast("string")
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit(last)), F.lpad(text, 18, "0")).cast("decimal(38,0)")


def to_drop(rows: DataFrame) -> DataFrame:
    """``rows``, written as what a join takes as small or large by the size of its files, so without compression."""
    return written(rows, "drop", "none")


def without(docs: DataFrame, found, drop) -> DataFrame:
    """``docs`` without those rows for which ``drop`` holds in found(docs, id column), a written table, which is deleted."""
    name = "doc_id" if ids_name_rows(docs) else "_name"
    named = docs if name == "doc_id" else docs.withColumn("_name", row_name())
    all_rows = found(named, name)
    gone = to_drop(all_rows.filter(drop).select(name))
    discard(all_rows)
    return named.join(gone, name, "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return reject_toxic(docs, train(docs, table(spark, sf_dir, "labels"), use=learn), threshold=0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if ids_name_rows(docs):
        return docs.join(to_drop(exact_dedup(docs).filter(~F.col("kept")).select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    found = exact_dedup(docs).select("doc_id", "kept", F.col("text_sha256").alias("_sha"))
    rows = docs.withColumn("_sha", F.sha2(normalised(F.col("text")), 256))
    # what an id and a text are kept for is one decision, however many rows have both
    groups = found.groupBy("doc_id", "_sha").agg(F.bool_and("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    groups = to_drop(groups.filter("NOT _kept OR _n > 1").withColumnsRenamed({"doc_id": "_id", "_sha": "_of"}))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_of"))
    repeated = rows.join(groups.filter("_kept"), same, "left_semi")
    none = (F.col("doc_id").isNull() & F.col("text").isNull()).alias("_none")
    one = repeated.groupBy("_sha", none).agg(F.min(F.struct(*docs.columns)).alias("_row"))  # combined where the copies lie
    return rows.join(groups, same, "left_anti").select(docs.columns).unionByName(one.select("_row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, lambda rows, id_col: near_duplicates(rows, id_col, shingle=5, similarity=0.8), ~F.col("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return without(docs, lambda rows, id_col: contamination(rows, benchmark, id_col, window=10), F.size("hits") > 0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: Training a classifier and MinHash are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage kept is deleted once the next one has written what it keeps."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
