"""When a node runs, and what that decides: which rows it takes in, and its replies to requests (SRC1, VAL1, VAL6, VAL7).

Lifecycle rows are robot_id, ts, event_id, kind (start or stop) and the result of a start: a
negative one is a failed connect, after which there are neither timers nor topics. A node runs
from a start that succeeded to the next stop or failed start. No row: it does not run yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import Last, running, sliced, whole
from .params import rejection, sets

_KEYS, _ORDER = ["robot_id"], ["ts", "event_id", "_row"]


def started(kind: Column, result: Column) -> Column:
    """Whether the node runs after a lifecycle row."""
    return (kind == "start") & (F.coalesce(result, F.lit(0)) >= 0)


def running_as_of(rows: DataFrame, lifecycle: DataFrame, slices: int | None = None) -> DataFrame:
    """``rows`` (robot_id, ts, event_id, any more) with is_running. A lifecycle row counts for rows with its own (ts, event_id).

    One union and one window, no range join; see `running.sliced` for ``slices``.
    """
    states = lifecycle.select("robot_id", "ts", "event_id", started(F.col("kind"), F.col("result")).alias("_on"), F.lit(0).alias("_row"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(states, allowMissingColumns=True)
    out = whole(running(sliced(both, _KEYS, _ORDER, slices), _KEYS, _ORDER, _running=Last("_on")))
    return out.filter("_row = 1").select(*rows.columns, F.coalesce("_running", F.lit(False)).alias("is_running"))


def gated(rows: DataFrame, lifecycle: DataFrame, slices: int | None = None) -> DataFrame:
    """The rows that a running node takes in."""
    return running_as_of(rows, lifecycle, slices).filter("is_running").drop("is_running")


def reason(node: Column, changes: Column, is_running: Column) -> Column:
    """Why a set of changes (name, value) is rejected as a whole: the reason of the last change that is; empty if it is accepted."""
    reasons = F.filter(F.transform(changes, lambda c: rejection(node, c["name"], c["value"], is_running)), lambda r: r.isNotNull())
    return F.coalesce(F.try_element_at(reasons, F.lit(-1)), F.lit(""))


def replies(requests: DataFrame, lifecycle: DataFrame, slices: int | None = None) -> DataFrame:
    """requests: robot_id, ts, event_id, node, and sets of changes (see `params.sets`). One reply each: is_running as of it, successful, reason."""
    asked = running_as_of(sets(requests).select("robot_id", "ts", "event_id", "node", "changes"), lifecycle, slices)
    said = asked.withColumn("reason", reason(F.col("node"), F.col("changes"), F.col("is_running")))
    return said.select("robot_id", "event_id", "is_running", (F.col("reason") == "").alias("successful"), "reason")
