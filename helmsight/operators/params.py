"""Parameter validation and parameters as of a row (VAL1-8, ST7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BODY_DURATION_RANGE, SPEED_LIMIT_MODES
from ..functions.running import Last, running, sliced
from ..sources.topics import DEFAULTS

#: Reasons for a rejection; fixed values.
FROZEN = "Cannot change this parameter while node is running."
UNKNOWN = "The parameter is invalid."
BAD_MODE = "speed_limit_mode must be between 0 and 1."
BAD_DURATION = "body_speed_duration must be between 0 and 600 sec."


def rejection(node: Column, name: Column, value: Column, is_running: Column) -> Column:
    """Why a change is rejected, null if it is not. value is a string.

    A duration of NaN passes, as neither comparison with it holds. Camera sizes and
    rates are not checked against each other. A mode that is no integer is none of the
    modes, a duration that is no number is in no range, and both are rejected as such.
    """
    mode, seconds = value.try_cast("int"), value.try_cast("double")
    low, high = BODY_DURATION_RANGE
    driver = (
        F.when(name == "driver_uri", F.when(is_running, FROZEN))
        .when(name == "speed_limit_mode", F.when(mode.isNull() | ~mode.between(*SPEED_LIMIT_MODES), BAD_MODE))
        .when(name == "body_speed_duration", F.when(seconds.isNull() | (seconds < low) | ((seconds > high) & ~F.isnan(seconds)), BAD_DURATION))
        .when(name.isin("arm_robot", "hold"), None)
        .otherwise(UNKNOWN)
    )
    camera = F.when(name.isin(*DEFAULTS["camera"]), F.when(is_running, FROZEN)).otherwise(UNKNOWN)
    return F.when(node == "camera", camera).otherwise(driver)


def validated(changes: DataFrame, is_running: Column) -> DataFrame:
    """changes: batch, pos, node, name, value. Adds reason and ok, each change by itself."""
    return changes.withColumn("reason", rejection(F.col("node"), F.col("name"), F.col("value"), is_running)).withColumn("ok", F.col("reason").isNull())


def batch_results(checked: DataFrame) -> DataFrame:
    """Per set of changes: successful if all are; the reason of the last rejected one, empty if none."""
    return checked.groupBy("batch").agg(F.bool_and("ok").alias("successful"), F.coalesce(F.max_by(F.when(~F.col("ok"), F.col("reason")), F.when(~F.col("ok"), F.col("pos"))), F.lit("")).alias("reason"))


def sets(changes: DataFrame) -> DataFrame:
    """Changes that were requested together: rows with an array ``changes`` of (name, value).

    A table with a row for each change (name, value) has sets of one.
    """
    return changes if "changes" in changes.columns else changes.withColumn("changes", F.array(F.struct("name", "value")))


def accepted_values(changes: DataFrame, types: dict[str, str], node: str = "driver") -> DataFrame:
    """Rows (robot_id, event_id, ts, a column for each of ``types``) of the sets that a running node accepts.

    A set is accepted as a whole: if one of its changes is rejected, none is applied. Of
    several changes of one parameter in a set the last counts; null: it was not changed.
    """
    whole = sets(changes).filter(~F.exists("changes", lambda c: rejection(F.lit(node), c["name"], c["value"], F.lit(True)).isNotNull()))
    value = lambda n: F.try_element_at(F.filter("changes", lambda c: c["name"] == n), F.lit(-1))["value"]
    return whole.select("robot_id", "event_id", "ts", *(value(n).try_cast(t).alias(n) for n, t in types.items()))


def as_of(rows: DataFrame, changes: DataFrame, types: dict[str, str], node: str = "driver", slices: int | None = None) -> DataFrame:
    """``rows`` with the value of each parameter in ``types`` as of the row: the last accepted change at or before it.

    changes: robot_id, event_id, ts, and name, value or an array of them (see `sets`). One
    union and one window, no range join. A change counts for the row with its own
    (ts, event_id). Extra columns of ``rows`` stay. ``slices``: see `running.sliced`.
    """
    keys = ["robot_id", "ts", "event_id"]
    said = accepted_values(changes, types, node).select(*keys, *(F.col(n).alias(f"_p_{n}") for n in types), F.lit(0).alias("_row"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(said, allowMissingColumns=True)
    order = ["ts", "event_id", "_row"]
    out = running(sliced(both, ["robot_id"], order, slices), ["robot_id"], order, **{f"_v_{n}": Last(f"_p_{n}") for n in types})
    default = DEFAULTS[node]
    return out.filter("_row = 1").select(*rows.columns, *(F.coalesce(f"_v_{n}", F.lit(default[n]).try_cast(t)).alias(n) for n, t in types.items()))
