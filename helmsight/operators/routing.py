"""Which rows go on (FLT1-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LEFT_WHEEL, RIGHT_WHEEL

WHEELS = (LEFT_WHEEL, RIGHT_WHEEL)


def received(frames: DataFrame) -> DataFrame:
    """Frames that came in whole; only these are published."""
    return frames.filter(F.col("status") == "ok")


def counted_status(status: Column) -> Column:
    """Status for error edges: a read that would have blocked says nothing."""
    return F.when(status != "would_block", status)


def wheel_commands(joint: DataFrame) -> DataFrame:
    """One row per named wheel of a joint command, with its place in the message; names are case-sensitive.

    A name without a velocity has a null one.
    """
    pairs = F.transform("joint_names", lambda n, i: F.struct(i.alias("pos"), n.alias("wheel"), F.get("velocities", i).alias("velocity")))
    return joint.select("robot_id", "event_id", "ts", "duration", F.inline(pairs)).filter(F.col("wheel").isin(*WHEELS))


def names_a_wheel(joint_names: Column) -> Column:
    return F.exists(joint_names, lambda n: n.isin(*WHEELS))


def with_image(images: DataFrame, payload: str) -> DataFrame:
    """Images that are not empty."""
    size = F.length(payload) if dict(images.dtypes)[payload] == "binary" else F.size(payload)
    return images.filter(size > 0)


def when_armed(armed: Column, value: Column) -> Column:
    return F.when(armed, value).otherwise(F.lit(0.0))
