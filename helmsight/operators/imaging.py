"""Images: matrix views, encoding, gap filling, rate limits (IMG1-8, SNK4).

Which image a message shows is worked out on ids and statuses alone (`references`); the
payloads of images that came never move, and those that fill gaps are fetched by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.running import Last, running, sliced, whole


def pixel(data: Column, width: Column, i: Column, j: Column) -> Column:
    """Element (i, j) of a row-major matrix."""
    return F.get(data, i * width + j)


def channel(data: Column, width: Column, i: Column, j: Column, c: int) -> Column:
    """Channel c (0 blue, 1 green, 2 red) of pixel (i, j) of BGR bytes."""
    return F.conv(F.hex(F.substring(data, (i * width + j) * 3 + c + 1, F.lit(1))), 16, 10).cast("int")


_STREAM, _IN_ORDER = ["robot_id"], ["image_id"]


def _header(frame_id: str, encoding: str, filled: Column) -> list[Column]:
    """Filled messages have an unset header."""
    return [
        F.lit(encoding).alias("encoding"), F.when(~filled, F.col("image_id")).alias("stamp"),
        F.when(filled, F.lit("")).otherwise(F.lit(frame_id)).alias("frame_id"),
    ]


def depth_bytes(pixels: Column) -> Column:
    """16-bit pixels as bytes, the lower one first, as messages hold them."""
    digits = F.transform(pixels, lambda p: F.lpad(F.hex(F.shiftleft(p.bitwiseAND(255), 8).bitwiseOR(F.shiftright(p, 8))), 4, "0"))
    return F.unhex(F.array_join(digits, ""))


def references(images: DataFrame, frame_id: str, encoding: str, slices: int | None = None) -> DataFrame:
    """images: robot_id, image_id (in order, one row each), status, height, width. One row per message, with the id of the image that it shows.

    * ok: the image itself, with frame id and a header;
    * no_frame, stream_error: the last image again, its header unset; null (an empty image) before there was any;
    * data_error: nothing is sent, and the last image stays what it was.

    ``slices``: see `running.sliced`. No payload is read.
    """
    thin = images.select("robot_id", "image_id", "status", "height", "width")
    came = thin.withColumn("_came", F.when(F.col("status") == "ok", F.col("image_id")))
    d = whole(running(sliced(came, _STREAM, _IN_ORDER, slices), _STREAM, _IN_ORDER, shown=Last("_came")))
    filled = F.col("status").isin("no_frame", "stream_error")
    return d.filter(F.col("status") != "data_error").select(
        "robot_id", "image_id", "height", "width", *_header(frame_id, encoding, filled), "shown", filled.alias("is_filled")
    )


def gap_filled(images: DataFrame, payload: str, frame_id: str, encoding: str, slices: int | None = None) -> DataFrame:
    """The messages of `references` with the payloads of the images that they show.

    Images that came are passed on from their scan. Messages that fill gaps fetch theirs by
    (robot, id of the image shown), a join that adaptive execution can split where one
    image is shown over and over; those before the first image have nothing to fetch.
    """
    size = ["robot_id", "image_id", "height", "width"]
    came = images.filter(F.col("status") == "ok")
    sent = came.select(*size, *_header(frame_id, encoding, F.lit(False)), payload, F.lit(False).alias("is_filled"))
    gaps = references(images, frame_id, encoding, slices).filter("is_filled")
    # keys of their own keep messages that show nothing from meeting as nulls in one task
    gaps = gaps.withColumn("_key", F.coalesce(F.col("shown").cast("string"), F.concat(F.lit("none "), F.col("image_id"))))
    kept = came.select(F.col("robot_id").alias("_of"), F.col("image_id").cast("string").alias("_image"), payload)
    found = gaps.join(kept, F.col("robot_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_image")), "left")
    return sent.unionByName(found.select(sent.columns))


def latest_per(rows: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """The last row of each robot and bucket, whole. Combined on the map side: max of structs."""
    whole = F.struct(*order, *(c for c in rows.columns if c not in order))
    return rows.groupBy("robot_id", bucket.alias("bucket")).agg(F.max(whole).alias("_row")).select("bucket", *(F.col("_row")[c].alias(c) for c in rows.columns))


def latest_per_ranked(rows: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """The same by rank, for rows with columns that have no order (maps)."""
    w = W.partitionBy("robot_id", "bucket").orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("bucket", bucket).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
