"""Gamepad samples to motion and LED commands (JOY1-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BIT_A, BIT_LB, STEERING_GAIN, THROTTLE_GAIN
from ..functions.running import Last, Sum, running, sliced, whole
from .routing import when_armed

KEYS, ORDER = ["robot_id"], ["ts", "event_id"]


def bit(buttons: Column, n: int) -> Column:
    return F.shiftright(buttons, n).bitwiseAND(1)


def decoded(samples: DataFrame) -> DataFrame:
    """Adds lla, rt, lt and the buttons a and lb. Adding 0.0 turns -0.0 into 0.0."""
    b = F.col("buttons")
    return samples.withColumns({"lla": F.lit(-1.0) * F.col("x") + 0.0, "rt": F.col("rz"), "lt": F.col("z"), "a": bit(b, BIT_A), "lb": bit(b, BIT_LB)})


def with_armed(samples: DataFrame, slices: int | None = None) -> DataFrame:
    """Adds armed: each press of LB toggles it, holding does not; off at first."""
    d = running(sliced(samples, KEYS, ORDER, slices), KEYS, ORDER, _before=Last("lb", before=True))
    d = d.withColumn("_edge", ((F.col("lb") == 1) & (F.coalesce("_before", F.lit(0)) == 0)).cast("int"))
    return whole(running(d, KEYS, ORDER, _edges=Sum("_edge"))).withColumn("armed", F.col("_edges") % 2 == 1).drop("_before", "_edge", "_edges")


def speeds(rt: Column, lt: Column, lla: Column) -> tuple[Column, Column]:
    """(throttle, steering) while armed: right trigger forward, else left trigger back, else turn in place."""
    ahead, back = rt > 0, lt > 0
    gain, steer = F.lit(THROTTLE_GAIN), F.lit(STEERING_GAIN)
    throttle = F.when(ahead, gain * (0.5 + F.lit(0.5) * rt)).when(back, -gain * (0.5 + F.lit(0.5) * lt)).otherwise(F.lit(0.0))
    return throttle, F.when(~ahead & back, -steer * lla).otherwise(steer * lla) + 0.0


def motion(armed_samples: DataFrame, also: tuple[Column, ...] = ()) -> DataFrame:
    """cmd_vel messages, one per sample, with other columns of it."""
    throttle, steering = speeds(F.col("rt"), F.col("lt"), F.col("lla"))
    on = F.col("armed")
    return armed_samples.select("robot_id", "event_id", "ts", when_armed(on, throttle).alias("linear_x"), when_armed(on, steering).alias("angular_z"), *also)


def led_columns(on: Column) -> tuple[Column, ...]:
    """Green while armed, else blue."""
    return F.lit(0.0).alias("r"), F.when(on, 1.0).otherwise(0.0).alias("g"), F.when(on, 0.0).otherwise(1.0).alias("b"), F.lit(1.0).alias("a")


def leds(armed_samples: DataFrame) -> DataFrame:
    """LED messages, one per sample."""
    return armed_samples.select("robot_id", "event_id", "ts", *led_columns(F.col("armed")))


def manual_drive(samples: DataFrame, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    armed = with_armed(decoded(samples), slices)
    return motion(armed), leds(armed)
