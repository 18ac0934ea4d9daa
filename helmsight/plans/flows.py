"""From recorded topics to command frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commands, driver, gamepad


def writes(body: DataFrame, led: DataFrame, joint: DataFrame | None = None) -> DataFrame:
    """Write rows of the command topics; timeouts of body commands are left to the driver's log."""
    out = commands.body_writes(body.withColumn("body_speed_duration", F.lit(None).cast("double"))).unionByName(commands.led_writes(led))
    return out if joint is None else out.unionByName(commands.joint_writes(joint))


def drive(ticks: DataFrame, wrote: DataFrame, changes: DataFrame, slices: int | None = None) -> DataFrame:
    """Command frames from ticks, write rows and parameter changes."""
    return driver.command_frames(driver.driver_log(ticks, wrote, changes), slices)


def gamepad_to_frames(samples: DataFrame, ticks: DataFrame, changes: DataFrame, slices: int | None = None) -> DataFrame:
    """Gamepad -> toggle -> speed and LED commands -> tick machine -> command frames."""
    armed = gamepad.with_armed(gamepad.decoded(samples), slices)
    both = gamepad.motion(armed, also=gamepad.led_columns(F.col("armed")))
    return drive(ticks, commands.drive_writes(both), changes, slices)
