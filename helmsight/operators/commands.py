"""Commands as writes to the slots of the command frame (CMD1-5).

A write row has a column per slot, null where the command leaves the slot alone, and
for valid speed commands `kind` (body or wheel) and `stop`, the timeout in ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LEFT_WHEEL, RIGHT_WHEEL, TICK_MS
from .routing import names_a_wheel, wheel_commands

KEYS = ["robot_id", "event_id", "ts"]
SLOTS = ["user_led", "r", "g", "b", "w7", "w8"]
WRITES = [*KEYS, *SLOTS, "kind", "stop"]


def ticks(seconds: Column) -> Column:
    """A duration in ticks, halves away from zero; null where it does not fit an integer."""
    return F.round(seconds * 1000.0 / float(TICK_MS)).try_cast("int")


def _writes(df: DataFrame, **given: Column) -> DataFrame:
    kinds = {"kind": "string", "stop": "int"}
    return df.select(*KEYS, *(given.get(c, F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in [*SLOTS, "kind", "stop"]))


def led_writes(led: DataFrame) -> DataFrame:
    return _writes(led, user_led=F.col("a"), r=F.col("r"), g=F.col("g"), b=F.col("b"))


def body_writes(body: DataFrame) -> DataFrame:
    """body has the parameter body_speed_duration as of the command."""
    return _writes(body, w7=F.col("linear_x"), w8=F.col("angular_z"), kind=F.lit("body"), stop=ticks(F.col("body_speed_duration")))


def drive_writes(both: DataFrame) -> DataFrame:
    """Speed and LED commands that came together, as one write each; timeouts are left to the driver's log."""
    return _writes(both, w7=F.col("linear_x"), w8=F.col("angular_z"), kind=F.lit("body"), user_led=F.col("a"), r=F.col("r"), g=F.col("g"), b=F.col("b"))


def joint_writes(joint: DataFrame) -> DataFrame:
    """One row per command, without any shuffle: of a wheel that is named twice the last velocity counts.

    A command that names no wheel writes nothing and has no kind, so it resets no timeout.
    """
    pairs = F.transform("joint_names", lambda n, i: F.struct(n.alias("wheel"), F.get("velocities", i).alias("velocity")))
    last = lambda wheel: F.element_at(F.filter(pairs, lambda p: p["wheel"] == wheel), -1)["velocity"]
    any_of = lambda wheel: F.when(F.array_contains("joint_names", wheel), last(wheel))
    valid = names_a_wheel(F.col("joint_names"))
    return _writes(joint, w7=any_of(LEFT_WHEEL), w8=any_of(RIGHT_WHEEL), kind=F.when(valid, "wheel"), stop=F.when(valid, ticks(F.col("duration"))))


def joint_writes_by_wheel(joint: DataFrame) -> DataFrame:
    """The same from exploded rows, for logs that hold a row per wheel already."""
    last = lambda wheel: F.max_by(F.when(F.col("wheel") == wheel, F.col("velocity")), F.when(F.col("wheel") == wheel, F.col("pos")))
    return wheel_commands(joint).groupBy(*KEYS).agg(last(LEFT_WHEEL).alias("w7"), last(RIGHT_WHEEL).alias("w8"), ticks(F.first("duration")).alias("stop"))
