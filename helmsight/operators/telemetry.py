"""One telemetry frame to four messages (PRJ1-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BASE_FRAME, DESIGN_CAPACITY, WHEEL_BASE, WHEEL_RADIUS
from .routing import received

_KEYS = ("robot_id", "event_id")


def header(frame_id: str = BASE_FRAME) -> Column:
    """The one time of receipt, shared by all messages of a frame."""
    return F.struct(F.col("ts").alias("stamp"), F.lit(frame_id).alias("frame_id")).alias("header")


def forward_kinematics(right: Column, left: Column) -> tuple[Column, Column]:
    """Body speed (forward, turn) from wheel speeds in rad/s; wheel 0 counts as the right one."""
    v_right, v_left = right * F.lit(WHEEL_RADIUS), left * F.lit(WHEEL_RADIUS)
    return (v_right + v_left) / F.lit(2.0), (v_right - v_left) / F.lit(WHEEL_BASE)


def _twist() -> list[Column]:
    x, z = forward_kinematics(F.col("tach0"), F.col("tach1"))
    return [F.struct(F.struct(x.alias("x")).alias("linear"), F.struct(z.alias("z")).alias("angular")).alias("twist")]


def _battery() -> list[Column]:
    """What is not measured is NaN, not null."""
    unknown = F.lit(float("nan"))
    return [
        F.col("battery_v").alias("voltage"), *(unknown.alias(n) for n in ("temperature", "current", "charge", "capacity", "percentage")),
        F.lit(DESIGN_CAPACITY).alias("design_capacity"),
        F.lit("DISCHARGING").alias("power_supply_status"), F.lit("GOOD").alias("power_supply_health"), F.lit("LIPO").alias("power_supply_technology"), F.lit(True).alias("present"),
    ]


def _imu() -> list[Column]:
    axes = lambda p: F.struct(*(F.col(f"{p}_{a}").alias(a) for a in "xyz"))
    return [axes("acc").alias("linear_acceleration"), axes("gyro").alias("angular_velocity")]


def _joint() -> list[Column]:
    both = lambda p: F.array(f"{p}0", f"{p}1")
    return [both("enc").alias("position"), both("tach").alias("velocity"), both("cur").alias("effort")]


#: topics of a frame and what their messages hold besides keys and header
_PAYLOADS = {"speed_feedback": _twist, "battery": _battery, "imu": _imu, "joint": _joint}


def message(frames: DataFrame, topic: str) -> DataFrame:
    return received(frames).select(*_KEYS, header(), *_PAYLOADS[topic]())


def speed_feedback(frames: DataFrame) -> DataFrame:
    return message(frames, "speed_feedback")


def battery_state(frames: DataFrame) -> DataFrame:
    return message(frames, "battery")


def imu(frames: DataFrame) -> DataFrame:
    return message(frames, "imu")


def joint_state(frames: DataFrame) -> DataFrame:
    return message(frames, "joint")


def fan_out(frames: DataFrame) -> dict[str, DataFrame]:
    """The four topics of a frame, each with a scan of its own; `messages` has one for all."""
    return {topic: message(frames, topic) for topic in _PAYLOADS}


def messages(frames: DataFrame) -> DataFrame:
    """The messages of all topics from one scan: robot_id, event_id, topic, header, and a struct for each topic, null but for the message's own."""
    every = received(frames).select("*", F.explode(F.array(*(F.lit(t) for t in _PAYLOADS))).alias("topic"))
    return every.select(*_KEYS, "topic", header(), *(F.when(F.col("topic") == t, F.struct(*columns())).alias(t) for t, columns in _PAYLOADS.items()))
