"""Adapters that read robot topics out of an event log and images out of vectors.

They are conventions of this library: user_id is the robot, k is the number in `props`,
and arithmetic on value and k fills the slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import WOULD_BLOCK

ORDER = ["ts", "event_id"]
KEYS = ["robot_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("event_id", "ts", F.col("user_id").alias("robot_id"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def telemetry(e: DataFrame) -> DataFrame:
    """Frames with their receive status; ts is the time of receipt."""
    v, k = F.col("value"), F.col("k").cast("double")
    slots = {
        "enc0": v * 2.0, "enc1": v * 3.0, "tach0": v / 50.0, "tach1": (k - 50.0) / 10.0, "volt0": v / 100.0, "volt1": k / 10.0,
        "acc_x": v / 1000.0, "acc_y": k / 100.0, "acc_z": v / 500.0, "gyro_x": k / 7.0, "gyro_y": v / 11.0, "gyro_z": k - v,
        "cur0": v / 13.0, "cur1": k / 3.0, "battery_v": 10.0 + k / 50.0, "watchdog": F.when(k > 90.0, 1.0).otherwise(0.0), "device_ts": v + k,
    }
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "would_block").otherwise("ok")
    return e.select("robot_id", "event_id", "ts", status.alias("status"), *(c.alias(n) for n, c in slots.items()))


def link_results(e: DataFrame) -> DataFrame:
    """Rows (robot_id, event_id, ts, received, sent): results of a tick's read and send, negative ones errors.

    Errors are read with error rows and reads would have blocked with view rows, as in `telemetry`; of
    sends every tenth k fails, and every twentieth would have blocked.
    """
    k = F.col("k")
    received = F.when(F.col("event_type") == "error", -1 - k % 7).when(F.col("event_type") == "view", WOULD_BLOCK).otherwise(0)
    sent = F.when(k % 20 == 13, WOULD_BLOCK).when(k % 10 == 3, -1 - k % 4).otherwise(0)
    return e.select("robot_id", "event_id", "ts", received.cast("int").alias("received"), sent.cast("int").alias("sent"))


def lifecycle(e: DataFrame) -> DataFrame:
    """Starts come with signup rows and fail where 4 divides k, stops with purchase rows whose k 5 divides."""
    k = F.col("k")
    kind = F.when(F.col("event_type") == "signup", "start").when((F.col("event_type") == "purchase") & (k % 5 == 0), "stop")
    result = F.when((F.col("event_type") == "signup") & (k % 4 == 0), -1 - k % 3).when(F.col("event_type") == "signup", 0)
    return e.select("robot_id", "ts", "event_id", kind.alias("kind"), result.cast("int").alias("result")).filter("kind is not null")


def requests(e: DataFrame) -> DataFrame:
    """Sets of two changes, to the camera where 5 divides k, else to the driver."""
    k = F.col("k")
    names = F.array(*(F.lit(n) for n in ("driver_uri", "speed_limit_mode", "hold", "no_such", "camera_num")))
    one = lambda at, value: F.struct(F.get(names, at).alias("name"), value.cast("string").alias("value"))
    changes = F.array(one(k % 5, k % 2), one((k + F.col("event_id").cast("int")) % 5, k % 4))
    return e.select("robot_id", "ts", "event_id", F.when(k % 5 == 0, "camera").otherwise("driver").alias("node"), changes.alias("changes"))


def camera_results(images: DataFrame) -> DataFrame:
    """images with ``code``: of the frames that did not come, those with an id that 3 divides are stream errors."""
    status = F.when((F.col("status") == "no_frame") & (F.col("image_id") % 3 == 0), "stream_error").otherwise(F.col("status"))
    code = F.when(F.col("status") == "no_frame", WOULD_BLOCK).when(F.col("status") == "ok", 0).otherwise(-1 - F.col("image_id") % 5)
    images = images.withColumn("status", status)
    return images.withColumn("code", F.when(F.col("status") == "stream_error", -2 - F.col("image_id") % 4).otherwise(code).cast("int"))


def body_commands(e: DataFrame) -> DataFrame:
    return e.filter("event_type = 'click'").select("robot_id", "event_id", "ts", F.col("value").alias("linear_x"), (F.col("value") / 10.0).alias("angular_z"))


def joint_commands(e: DataFrame) -> DataFrame:
    kind, v = F.col("k") % 4, F.col("value")
    names = (
        F.when(kind == 0, F.array(F.lit("left_wheel"), F.lit("right_wheel")))
        .when(kind == 1, F.array(F.lit("left_wheel")))
        .when(kind == 2, F.array(F.lit("right_wheel")))
        .otherwise(F.array(F.lit("caster")))
    )
    speeds = F.when(kind == 0, F.array(v, -v)).when(kind == 2, F.array(-v)).otherwise(F.array(v))
    return e.filter("event_type = 'purchase'").select(
        "robot_id", "event_id", "ts", names.alias("joint_names"), speeds.alias("velocities"), ((F.col("k") % 8) * 0.02).alias("duration")
    )


def led_commands(e: DataFrame) -> DataFrame:
    """LED colours come with error rows, apart from what these say as telemetry."""
    k = F.col("k")
    return e.filter("event_type = 'error'").select(
        "robot_id", "event_id", "ts", (k / 100.0).alias("r"), ((100 - k) / 100.0).alias("g"), F.lit(0.5).alias("b"), (k % 2).cast("double").alias("a")
    )


def parameter_sets(e: DataFrame) -> DataFrame:
    """arm_robot and hold come with signup rows, speed_limit_mode with view rows, body_speed_duration with click rows.

    What a row sets was requested together: an array ``changes`` of (name, value).
    """
    k, bool_ = F.col("k"), lambda c: F.when(c, "true").otherwise("false")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    said = (
        F.when(F.col("event_type") == "signup", F.array(pair("arm_robot", bool_(k >= 30)), pair("hold", bool_(k % 2 == 0))))
        .when(F.col("event_type") == "view", F.array(pair("speed_limit_mode", k % 3 - (k > 80).cast("int"))))
        .when(F.col("event_type") == "click", F.array(pair("body_speed_duration", (k % 8) * 0.02)))
    )
    return e.select("robot_id", "event_id", "ts", F.lit("driver").alias("node"), said.alias("changes")).filter("changes is not null")


def parameter_changes(e: DataFrame) -> DataFrame:
    """The same, a row for each change."""
    return parameter_sets(e).select("robot_id", "event_id", "ts", "node", F.inline("changes"))


def gamepad(e: DataFrame) -> DataFrame:
    k = F.col("k").cast("double")
    buttons = F.when(F.col("event_type").isin("click", "view"), 16).otherwise(0) + F.col("k") % 2
    return e.select("robot_id", "event_id", "ts", ((k - 50.0) / 50.0).alias("x"), ((20.0 - k) / 20.0).alias("z"), ((k - 60.0) / 40.0).alias("rz"), buttons.cast("int").alias("buttons"))


_IMAGE = ("robot_id", "image_id")
_SIZE = ("height", "width")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    raw = F.transform("embedding", lambda x: F.floor(F.pmod(x.cast("double"), F.lit(1.0)) * 65535.0).cast("int"))
    return df.select((F.col("vec_id") % 5).alias("robot_id"), F.col("vec_id").alias("image_id"), "vec_id", "label", F.lit(8).alias("height"), F.lit(8).alias("width"), raw.alias("raw"))


def depth_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images of 16-bit depths out of vectors; label 0: no frame came; label 1 and an even id: its data could not be had."""
    df = _vectors(spark, sf_dir)
    status = F.when(F.col("label") == 0, "no_frame").when((F.col("label") == 1) & (F.col("vec_id") % 2 == 0), "data_error").otherwise("ok")
    return df.select(*_IMAGE, status.alias("status"), *_SIZE, F.when(status == "ok", F.col("raw")).alias("pixels"))


def color_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images in BGR bytes, each channel the upper byte of the depth; statuses as for depth, for other ids."""
    d = _vectors(spark, sf_dir)
    status = F.when(F.col("image_id") % 7 == 0, "no_frame").when(F.col("image_id") % 7 == 1, "data_error").otherwise("ok")
    digits = F.transform("raw", lambda p: F.repeat(F.lpad(F.hex(F.shiftright(p, 8)), 2, "0"), 3))
    known = F.when(status == "ok", F.unhex(F.array_join(digits, "")))
    return d.select(*_IMAGE, status.alias("status"), *_SIZE, known.alias("data"))
