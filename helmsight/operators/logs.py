"""Text logs of the nodes as one relation (SNK5, ST2, ST3, FLT2).

A log row is robot_id, node, at (the id of the row that it is about), severity, code and
message. The driver's link logs edges: the first error after all was well and the first
success after an error. A camera logs every error. A read that would have blocked is none.
Texts are fixed values; what the device is called, and how codes are put in words, are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import Last, running, sliced

#: The result of a read that would have blocked, by this library's convention; all errors are negative.
WOULD_BLOCK = -34
INFO, ERROR = "INFO", "ERROR"
#: verbs and prepositions of the link's two directions, and of its recoveries
_RECEIVING, _SENDING = ("receiving data from", "Data received from"), ("sending data to", "Data sent to")
_LOG = ("robot_id", "node", "at", "severity", "code", "message")


def in_words(texts: dict[int, str] | None = None):
    """code -> what it means, for messages; unknown ones are "unspecified error"."""
    known = texts or {}

    def text(code: Column) -> Column:
        out = F.lit("unspecified error")
        for number, words in known.items():
            out = F.when(code == number, words).otherwise(out)
        return out

    return text


def _link(rows: DataFrame, result: Column, words: tuple[str, str], silent: Column, device: str, slices: int | None) -> DataFrame:
    keys, order = ["robot_id"], ["ts", "event_id"]
    ok = F.when(~silent, result >= 0)
    d = running(sliced(rows.withColumns({"_code": result, "_ok": ok}), keys, order, slices), keys, order, _was=Last("_ok", before=True))
    edges = d.filter(F.col("_ok").isNotNull() & (F.col("_ok") != F.coalesce("_was", F.lit(True))))
    failed = F.format_string(f"Error (%d) {words[0]} {device}. Make sure the {device} is running.", "_code")
    message = F.when(F.col("_ok"), F.lit(f"{words[1]} {device}.")).otherwise(failed)
    return edges.select("robot_id", F.lit("driver").alias("node"), F.col("event_id").alias("at"), F.lit(INFO).alias("severity"), F.col("_code").alias("code"), message.alias("message"))


def receive_log(rows: DataFrame, result: Column, device: str = "driver model", slices: int | None = None) -> DataFrame:
    """rows: robot_id, ts, event_id; result of each read. Null results say nothing, as do those that would have blocked."""
    return _link(rows, result, _RECEIVING, result.isNull() | (result == WOULD_BLOCK), device, slices)


def send_log(rows: DataFrame, result: Column, device: str = "driver model", slices: int | None = None) -> DataFrame:
    """The same of sends: any negative result is an error, one that would have blocked too."""
    return _link(rows, result, _SENDING, result.isNull(), device, slices)


def connect_log(attempts: DataFrame, result: Column) -> DataFrame:
    """attempts: robot_id, event_id. A failed connect is logged, a successful one is not."""
    failed = attempts.withColumn("_code", result).filter(F.col("_code") < 0)
    message = F.format_string("Error connecting stream: %d", "_code")
    return failed.select("robot_id", F.lit("driver").alias("node"), F.col("event_id").alias("at"), F.lit(INFO).alias("severity"), F.col("_code").alias("code"), message.alias("message"))


def frame_status(got_frame: Column, got_data: Column) -> Column:
    """ok, data_error (a frame without its data), no_frame (would have blocked) or stream_error, from the results of both calls."""
    return F.when(got_frame == WOULD_BLOCK, "no_frame").when(got_frame < 0, "stream_error").when(got_data < 0, "data_error").otherwise("ok")


def camera_log(frames: DataFrame, stream: str, code: Column, text=in_words()) -> DataFrame:
    """frames: robot_id, image_id, status (see `frame_status`); the code of the call that failed. One row per error."""
    of = {"data_error": f"Error getting data from {stream} frame: %d -> %s", "stream_error": f"Error getting frame from {stream} stream: %d -> %s"}
    bad = frames.withColumn("_code", code).filter(F.col("status").isin(*of))
    message = F.when(F.col("status") == "data_error", F.format_string(of["data_error"], "_code", text(F.col("_code")))).otherwise(F.format_string(of["stream_error"], "_code", text(F.col("_code"))))
    return bad.select("robot_id", F.lit("camera").alias("node"), F.col("image_id").alias("at"), F.lit(ERROR).alias("severity"), F.col("_code").alias("code"), message.alias("message"))


def log(*parts: DataFrame) -> DataFrame:
    """The nodes' logs as one."""
    out = parts[0].select(*_LOG)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_LOG))
    return out
