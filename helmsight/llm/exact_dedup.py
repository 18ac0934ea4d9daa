"""Exact deduplication with SQL functions only, safe under skew.

Three combining stages, each of which groups by the whole normalised text and
not by its digest alone:

1. local: the map side of the first aggregation leaves one row per text and task;
2. salted: rows of a digest that many tasks hold meet in ``salts`` groups;
3. global: the winners of the salts, at most ``salts`` rows per text, meet by digest.

What goes back to the documents is one row per digest, joined by the digest; the
join's sides are plain exchanges, so adaptive execution can split a hot digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest=lambda text: F.sha2(text, 256)
) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space became
    one space; of equal ones the row with the smallest id stays.

    * null text: counts as empty, so null, empty texts form one group;
    * null id: never the smallest; a group without any id has keep_id null and its
      rows are kept (nothing says which of them to drop);
    * rows that repeat a whole row, id included: each counts in group_size, all
      are reported alike;
    * empty table: no rows; other columns of ``docs`` are ignored, whatever their names.

    ``digest`` only routes rows. Texts that share a digest without being equal
    stay apart: groups are formed on the text, and a second digest (SHA-1 with the
    length) tells a document which group of its digest is its own. Should both
    digests of two different texts agree, the query fails instead of merging them.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    rows = rows.select("_id", "_text", digest(F.col("_text")).alias("_digest"))
    salted = (
        rows.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_digest", "_salt", "_text")
        .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    merged = salted.repartition("_digest").groupBy("_digest", "_text").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    second = lambda: F.concat(F.sha1("_text"), F.length("_text").cast("string"))
    # as many entries as there are different texts under one digest, which is 1 but for a collision
    routed = merged.select("_digest", F.struct(second().alias("own"), "_keep", "_n").alias("_c")).groupBy("_digest").agg(
        F.collect_list("_c").alias("_all")
    )
    mine = F.filter("_all", lambda c: c["own"] == F.col("_own"))
    # the computed key keeps the join from reusing the partitioning above: both its sides get
    # exchanges of its own, which adaptive execution can split where one digest is hot
    routed = routed.select(F.concat("_digest").alias("_key"), "_all")
    found = (
        rows.select("_id", "_digest", second().alias("_own"), F.sha2("_text", 256).alias("_sha"))
        .join(routed, F.col("_digest") == F.col("_key"))
        .withColumn("_mine", F.when(F.size(mine) == 1, mine[0]).otherwise(F.raise_error(F.lit("different texts share both digests"))))
    )
    keep = F.col("_mine._keep")
    return found.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.col("_mine._n").alias("group_size"),
        F.coalesce(F.col("_id") == keep, keep.isNull()).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
