"""Publishing streams: one scan of a micro-batch for all topics made of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.constants import COLOR_FRAME, DEPTH_FRAME, TICK_MS
from ..operators import gamepad
from ..schemas import COMMAND


def publish(rows: DataFrame, topics: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str) -> DataStreamWriter:
    """Write each topic of each micro-batch to ``path``/topic/batch=N.

    A micro-batch that is run again after a failure overwrites its own folders, so
    every message is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for topic, messages in topics(batch).items():
                messages.write.mode("overwrite").parquet(f"{path}/{topic}/batch={number}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def paced(writer: DataStreamWriter, period_ms: int = TICK_MS) -> DataStreamWriter:
    """At most one micro-batch per period, as timers pace nodes."""
    return writer.trigger(processingTime=f"{period_ms} milliseconds")


def command_topic(frames: DataFrame) -> dict[str, DataFrame]:
    """What is sent to the device: the frames of `processors.Driver` in the order of their slots."""
    return {"command": frames.select(*COMMAND.fieldNames())}


#: what became of each command frame
LEDGER = "robot_id bigint, event_id bigint, ts timestamp_ntz, n bigint, result int"


def send(frames: DataFrame, device: Callable[[], Callable[[dict], int]], path: str, checkpoint: str) -> DataStreamWriter:
    """Send command frames (robot_id, event_id, n and the slots) to a device, and keep a ledger of the results in ``path``.

    device: makes a function in a task that sends a frame and returns its result, negative for errors. A
    frame is tried once, as the next tick sends a newer one. The results of a micro-batch are written as
    one table; a micro-batch that is run again after its ledger was written is not sent again. A task that
    fails half-way is run again as a whole: (robot_id, n) names a frame, by which a device can tell
    that it has it.
    """

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = device()
        for batch in batches:
            results = [to(frame) for frame in batch.to_dict("records")]
            at = pd.to_datetime((batch["ts"] * 1e6).round().astype("int64"), unit="us")
            yield pd.DataFrame({"robot_id": batch["robot_id"], "event_id": batch["event_id"], "ts": at, "n": batch["n"], "result": pd.Series(results, index=batch.index, dtype="int32")})

    def write(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{path}/batch={number}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return
        in_order = batch.repartition("robot_id").sortWithinPartitions("robot_id", "n")
        in_order.mapInPandas(sent, LEDGER).write.mode("overwrite").parquet(folder)

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def gamepad_topics(samples: DataFrame) -> dict[str, DataFrame]:
    """Speed and LED commands from the rows of `processors.ManualDrive`, one of each a sample."""
    return {"cmd_vel": gamepad.motion(samples), "led_strip": gamepad.leds(samples)}


def ordered_topics(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows of `processors.reordered` that came in time, and beside them those that were late, with their count."""
    return {"ordered": rows.filter("NOT is_late").drop("is_late", "n_late"), "late": rows.filter("is_late").drop("is_late")}


def camera_topics(images: DataFrame) -> dict[str, DataFrame]:
    """Both image topics from the rows of `processors.Camera`; filled messages have no header."""
    filled = F.col("is_filled")

    def of(stream: str, frame: str, encoding: str) -> DataFrame:
        header = [F.when(~filled, F.col("event_id")).alias("stamp"), F.when(filled, F.lit("")).otherwise(F.lit(frame)).alias("frame_id")]
        return images.filter(F.col("stream") == stream).select("robot_id", "event_id", *header, F.lit(encoding).alias("encoding"), "data")

    return {"color_image": of("color", COLOR_FRAME, "bgr8"), "depth_image": of("depth", DEPTH_FRAME, "mono16")}


def camera_topic(stream: str) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """Images of a camera's stream, "color" or "depth", from the rows of `processors.GapFill`; filled ones have no header."""
    frame = {"color": COLOR_FRAME, "depth": DEPTH_FRAME}[stream]

    def topics(images: DataFrame) -> dict[str, DataFrame]:
        filled = F.col("is_filled")
        header = [F.when(~filled, F.col("event_id")).alias("stamp"), F.when(filled, F.lit("")).otherwise(F.lit(frame)).alias("frame_id")]
        return {f"{stream}_image": images.select("robot_id", "event_id", *header, "pixels")}

    return topics
