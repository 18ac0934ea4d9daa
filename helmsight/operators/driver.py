"""The driver's tick: what command frame it sends (CMD1-5, ST1, ST4-8).

The state looks recursive but a timeout depends only on the last valid command. So parameter
changes, commands and ticks become one log, and the frames are three rounds of running
values over it, in one partitioning and order: parameters and tick numbers; the last
command; the last write of each speed slot, where the zeros of timeouts and of disarming
are writes too. Commands between ticks need no folding: the last write of a slot wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LED_START
from ..functions.running import Last, Sum, running, sliced
from ..sources.topics import DEFAULTS
from .commands import SLOTS, ticks
from .params import accepted_values

KEYS, ORDER = ["robot_id"], ["ts", "event_id", "rank"]
PARAMETERS = {"speed_limit_mode": "int", "hold": "boolean", "arm_robot": "boolean"}
TIMED = {**PARAMETERS, "body_speed_duration": "double"}


def mode(kind: Column, limit: Column) -> Column:
    """0 wheel and 1 body under the education limit, 2 and 3 under the research one (any limit but 0)."""
    return F.when(kind == "body", 1.0).otherwise(0.0) + F.when(limit == 0, 0.0).otherwise(2.0)


def driver_log(tick_rows: DataFrame, writes: DataFrame, changes: DataFrame) -> DataFrame:
    """One log of all that a driver takes in.

    At equal (ts, event_id) changes come first, then writes, then the tick. ``writes`` of
    kind body have their timeout from the parameter, whatever their stop says. ``changes``
    may hold sets, which are accepted or rejected as a whole (see `params.sets`).
    """
    said = accepted_values(changes, TIMED).withColumn("rank", F.lit(0))
    wrote = writes.select("robot_id", "event_id", "ts", F.lit(1).alias("rank"), *SLOTS, "kind", "stop")
    came = tick_rows.select("robot_id", "event_id", "ts", F.lit(2).alias("rank"), F.lit(1).alias("tick"))
    return said.unionByName(wrote, allowMissingColumns=True).unionByName(came, allowMissingColumns=True)


def command_frames(log: DataFrame, slices: int | None = None) -> DataFrame:
    """One frame per tick of a `driver_log`, whatever was received. Adds n, the tick's number from 1, and timed_out.

    ``slices``: see `running.sliced`; the three rounds are over the same slices.
    """
    d = running(sliced(log, KEYS, ORDER, slices), KEYS, ORDER, _n=Sum("tick"), **{f"_{n}": Last(n) for n in TIMED})
    now = {n: F.coalesce(f"_{n}", F.lit(DEFAULTS["driver"][n]).try_cast(t)) for n, t in TIMED.items()}
    is_tick = F.col("tick").isNotNull()
    # a command counts from the first tick after it
    d = d.withColumns({**now, "n": F.col("_n") + F.when(is_tick, 0).otherwise(1)})
    stop = F.when(F.col("kind") == "body", ticks(F.col("body_speed_duration"))).otherwise(F.col("stop"))
    d = d.withColumn("_cmd", F.when(F.col("kind").isNotNull(), F.struct("n", "kind", stop.alias("stop"))))
    d = running(d, KEYS, ORDER, _last=Last("_cmd"), **{f"_{c}": Last(c) for c in LED_START})
    over = F.coalesce((F.col("_last.stop") > 0) & (F.col("n") - F.col("_last.n") + 1 > F.col("_last.stop")), F.lit(False))
    d = d.withColumn("timed_out", over)
    zero = is_tick & (F.col("timed_out") | ~F.col("arm_robot"))
    d = d.withColumns({f"_x{s}": F.when(zero, F.lit(0.0)).otherwise(F.col(f"w{s}")) for s in "78"})
    d = running(d, KEYS, ORDER, _s7=Last("_x7"), _s8=Last("_x8"))
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    return d.filter(is_tick).select(
        "robot_id", "n", "event_id", mode(F.col("_last.kind"), F.col("speed_limit_mode")).alias("mode"),
        *(F.coalesce(f"_{c}", F.lit(start)).alias(c) for c, start in LED_START.items()),
        flag("arm_robot").alias("enable"), flag("hold").alias("hold"),
        F.coalesce("_s7", F.lit(0.0)).alias("s7"), F.coalesce("_s8", F.lit(0.0)).alias("s8"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "timed_out",
    )
