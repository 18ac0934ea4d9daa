"""Stateful operators over live topics, one state per robot.

Spark allows only time windows on streams, so the running values of the batch operators
become state that each robot's rows step through in log order. Rows of a micro-batch are
sorted by (ts, event_id) and rank; rows that are equal in these all count, as in batch. A row
that comes after later ones were processed is late and is dropped, as the state cannot go
back; every output row says in `late` how many of its robot's rows have been. Logs that
arrive in order give what batch gives, wherever they are cut into micro-batches. Use the
RocksDB state store (`configure`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import LED_START, TICK_MS
from ..operators import lifecycle, params
from ..operators.driver import TIMED
from ..sources.topics import DEFAULTS


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _null(x) -> bool:
    return x is None or x is pd.NaT or (isinstance(x, float) and x != x)


class InOrder(StatefulProcessor):
    """Takes each robot's rows in order through one state, a tuple of the columns in STATE.

    A micro-batch's rows of one robot are held at once, so bound the files of a trigger.
    """

    STATE = ""
    START: tuple = ()
    OUTPUT = ""
    ORDER = ("ts", "event_id", "rank")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("state", f"at_ts timestamp_ntz, at_id bigint, at_rank int, late bigint, {self.STATE}")
        self.columns = [c.split()[0] for c in self.output().split(", ")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows), ignore_index=True)
        if "rank" not in df:
            df["rank"] = 0
        df = df.sort_values(list(self.ORDER), kind="stable", ignore_index=True)
        got = self.saved.get() if self.saved.exists() else None
        at, late, state = (None, 0, list(self.START)) if got is None else ((pd.Timestamp(got[0]), got[1], got[2]), got[3], list(got[4:]))
        if at is not None:
            ts, event, rank = (df[c] for c in self.ORDER)
            passed = (ts < at[0]) | ((ts == at[0]) & ((event < at[1]) | ((event == at[1]) & (rank < at[2]))))
            late += int(passed.sum())
            df = df[~passed].reset_index(drop=True)
        if len(df):
            at = (df["ts"].iat[-1], int(df["event_id"].iat[-1]), int(df["rank"].iat[-1]))
            made = self.steps(state, df)
        else:
            made = pd.DataFrame(columns=self.columns)
        self.saved.update((at[0].to_pydatetime(), at[1], at[2], late, *state))
        yield made.assign(robot_id=int(key[0]), late=late)[self.columns]

    def output(self) -> str:
        return f"robot_id bigint, event_id bigint, late bigint, {self.OUTPUT}"

    def steps(self, state: list, df: pd.DataFrame) -> pd.DataFrame:
        """Change the state in place by rows in order, at least one; output rows with their event_id.
        Here one row after the other, by `step`; over whole columns where a processor can."""
        out = []
        for row in df.to_dict("records"):
            if (made := self.step(state, row)) is not None:
                out.append({"event_id": int(row["event_id"]), **made})
        return pd.DataFrame(out, columns=[c for c in self.columns if c not in ("robot_id", "late")])

    def step(self, state: list, row: dict) -> dict | None:
        """Change the state in place; the columns of an output row, if the input row makes one."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Toggle(InOrder):
    """armed: each rising edge of lb toggles it."""

    STATE, START = "pressed int, armed boolean", (0, False)
    OUTPUT = "armed boolean"

    def steps(self, state, df):
        lb = df["lb"].astype("int64").to_numpy()
        before = np.concatenate([[state[0]], lb[:-1]])
        armed = state[1] ^ (np.cumsum((lb != 0) & (before == 0)) % 2 == 1)
        state[:] = int(lb[-1]), bool(armed[-1])
        return df[["event_id"]].assign(armed=armed)


class ManualDrive(Toggle):
    """Toggle for samples that `gamepad.decoded` made, with what their messages are made of."""

    OUTPUT = "ts timestamp_ntz, armed boolean, rt double, lt double, lla double"

    def steps(self, state, df):
        return super().steps(state, df).join(df[["ts", "rt", "lt", "lla"]])


class StatusEdges(InOrder):
    """edge where `now` (null: nothing is said) differs from the last one; well at first."""

    STATE, START = "was string", ("ok",)
    OUTPUT = "edge string"

    def steps(self, state, df):
        said = df.loc[df["now"].notna(), ["event_id", "now"]]
        changed = said[said["now"].to_numpy() != said["now"].shift(fill_value=state[0]).to_numpy()]
        if len(said):
            state[0] = str(said["now"].iat[-1])
        return changed[["event_id"]].assign(edge=np.where(changed["now"] == "ok", "recovered", "error"))


class GapFill(InOrder):
    """The image that is shown: `pixels` where status is ok, the last one where no frame came, no row for data errors."""

    STATE, START = "shown array<int>", (None,)
    OUTPUT = "pixels array<int>, is_filled boolean"

    def steps(self, state, df):
        status = df["status"].to_numpy()
        places = np.arange(len(df))
        shown = np.maximum.accumulate(np.where(status == "ok", places, -1))  # -1: what was shown before
        kept = status != "data_error"
        pixels = df["pixels"].to_numpy()
        images = [state[0] if i < 0 else pixels[i] for i in shown[kept]]
        if shown[-1] >= 0:
            state[0] = np.asarray(pixels[shown[-1]]).tolist()
        return pd.DataFrame({"event_id": df["event_id"].to_numpy()[kept], "pixels": pd.Series(images, dtype=object), "is_filled": status[kept] == "no_frame"})


class Camera(StatefulProcessor):
    """The messages of a camera's streams, color and depth alike: a map state holds, for each stream, the image that it shows.

    Rows: robot_id, event_id (an image's place in its stream), stream, status, data (bytes of any pixel
    format). As in `imaging.gap_filled`: an ok image is shown; no_frame and stream_error show the last one
    again; data_error sends nothing. Rows of a stream that come after later ones are late and are counted.
    A micro-batch's images of one robot are held at once, so bound the files of a trigger.
    """

    OUTPUT = "robot_id bigint, event_id bigint, late bigint, stream string, shown bigint, data binary, is_filled boolean"
    _COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getMapState("streams", "stream string", "at bigint, late bigint, shown bigint, data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batches = list(rows)
        order = sorted((stream, int(at), i, j) for i, b in enumerate(batches) for j, (stream, at) in enumerate(zip(b["stream"], b["event_id"], strict=True)))
        out, held, name = [], None, None
        for stream, at, i, j in order:
            if stream != name:
                if held is not None:
                    self.saved.updateValue((name,), tuple(held))
                name = stream
                held = list(self.saved.getValue((stream,))) if self.saved.containsKey((stream,)) else [None, 0, None, None]
            if held[0] is not None and at < held[0]:
                held[1] += 1
                continue
            held[0] = at
            status = batches[i]["status"].iat[j]
            if status == "ok":
                held[2], held[3] = at, bytes(batches[i]["data"].iat[j])
            if status != "data_error":
                out.append((int(key[0]), at, held[1], stream, held[2], held[3], status != "ok"))
            if len(out) == 64:
                yield self._frame(out)
                out = []
        if held is not None:
            self.saved.updateValue((name,), tuple(held))
        yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self._COLUMNS).astype({"shown": "Int64"})

    def output(self) -> str:
        return self.OUTPUT

    def close(self) -> None:
        pass


class Replies(InOrder):
    """Replies to requests by whether the node runs. Rows of `request_rows`: rank 0 lifecycle, rank 1 requests."""

    STATE, START = "running boolean", (False,)
    OUTPUT = "is_running boolean, successful boolean, reason string"

    def step(self, state, row):
        if row["rank"] == 0:
            state[0] = bool(row["on"])
            return None
        reason = row["if_running"] if state[0] else row["if_stopped"]
        return {"is_running": state[0], "successful": reason == "", "reason": reason}


def _plain(x):
    """A pandas cell as what a state takes; NaN counts as null."""
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    return x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") and not hasattr(x, "__len__") else x


class Reorder(StatefulProcessor):
    """Hands on each robot's rows in order: a row waits until one has come that is ``bound_ms`` later.

    So rows that come at most that much after later ones are put in their place. A row that comes after
    a later one was handed on is late: it is handed on at once with is_late, and n_late counts the robot's.
    Rows that wait are handed on too when a robot has been silent for ``idle_ms`` of processing time.
    """

    def __init__(self, schema: T.StructType, bound_ms: int, idle_ms: int | None = None):
        self.schema, self.bound, self.idle = schema, pd.Timedelta(milliseconds=bound_ms), idle_ms
        self.columns = schema.fieldNames()

    def output(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("is_late", T.BooleanType()), T.StructField("n_late", T.LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.saved = handle.getValueState("position", "at_ts timestamp_ntz, at_id bigint, newest timestamp_ntz, n_late bigint")

    def _rows(self, rows: list[tuple], late: bool, n: int) -> pd.DataFrame:
        return pd.DataFrame([(*r, late, n) for r in rows], columns=[*self.columns, "is_late", "n_late"])

    def _release(self, until, at, rows, newest, n_late):
        place = lambda r: (pd.Timestamp(r[self.columns.index("ts")]), r[self.columns.index("event_id")])
        rows = sorted(rows, key=place)
        cut = sum(place(r)[0] <= until for r in rows)
        if cut:
            at = place(rows[cut - 1])
        if rows[cut:]:
            self.waiting.put(rows[cut:])
        else:
            self.waiting.clear()
        self.saved.update((at[0].to_pydatetime() if at else None, at[1] if at else None, newest.to_pydatetime(), n_late))
        return self._rows(rows[:cut], False, n_late)

    def _state(self):
        if not self.saved.exists():
            return None, None, 0
        ts, key, newest, n = self.saved.get()
        return (pd.Timestamp(ts), key) if ts is not None else None, pd.Timestamp(newest), n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, newest, n_late = self._state()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        late = []
        for batch in rows:
            for row in batch[self.columns].itertuples(index=False, name=None):
                row = tuple(map(_plain, row))
                ts = pd.Timestamp(row[self.columns.index("ts")])
                if at is not None and (ts, row[self.columns.index("event_id")]) < at:
                    late.append(row)
                else:
                    waiting.append(row)
                newest = ts if newest is None else max(newest, ts)
        n_late += len(late)
        if late:
            yield self._rows(late, True, n_late)
        yield self._release(newest - self.bound, at, [tuple(r) for r in waiting], newest, n_late)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, newest, n_late = self._state()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield self._release(pd.Timestamp.max, at, rows, newest, n_late)

    def close(self) -> None:
        pass


class MostRecent(StatefulProcessor):
    """Of each robot's rows of a trigger the newest, if it is newer than what was handed on, and how many rows it passed over since.

    State: one position a robot, which is forgotten after ``ttl_ms`` without rows.
    """

    def __init__(self, schema: T.StructType, ttl_ms: int):
        self.schema, self.ttl = schema, ttl_ms

    def output(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("passed_over", T.LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("newest", "at_ts timestamp_ntz, at_id bigint, passed bigint", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, passed = None, 0
        if self.saved.exists():
            ts, event, passed = self.saved.get()
            at = (pd.Timestamp(ts), event)
        before, best, seen = at, None, 0
        for batch in rows:
            seen += len(batch)
            last = batch.sort_values(["ts", "event_id"], kind="stable").tail(1)
            place = (pd.Timestamp(last["ts"].iat[0]), int(last["event_id"].iat[0]))
            if at is None or place > at:
                at, best = place, last
        if best is None or at == before:
            self.saved.update((at[0].to_pydatetime(), at[1], passed + seen))
            return
        self.saved.update((at[0].to_pydatetime(), at[1], 0))
        yield best[self.schema.fieldNames()].assign(passed_over=passed + seen - 1)

    def close(self) -> None:
        pass


def ticks(seconds: float) -> int:
    """A duration in ticks, halves away from zero; 0 (no timeout) where it fits no integer."""
    n = seconds * 1000.0 / TICK_MS
    return int(math.copysign(math.floor(abs(n) + 0.5), n)) if abs(n) < 2**31 - 1 else 0


class Driver(InOrder):
    """Command frames. Rows of `driver_rows`: rank 0 parameters, rank 1 writes, rank 2 ticks.

    A body command has its timeout from the parameter as of the command, whatever its stop says.
    """

    STATE = (
        "arm boolean, hold boolean, lim int, seconds double, kind string, counter int, stop int, w7 double, w8 double, "
        "user_led double, r double, g double, b double, n bigint"
    )
    START = (True, False, 0, float(DEFAULTS["driver"]["body_speed_duration"]), "wheel", 0, 0, 0.0, 0.0, *LED_START.values(), 0)
    OUTPUT = (
        "n bigint, mode double, user_led double, r double, g double, b double, "
        "enable double, hold double, s7 double, s8 double, ts double"
    )
    _AT = {name.split()[0]: i for i, name in enumerate(STATE.split(", "))}

    def step(self, state, row):
        at = self._AT
        if row["rank"] == 0:
            for name, column in (("arm", "arm_robot"), ("hold", "hold"), ("lim", "speed_limit_mode")):
                if not _null(row[column]):
                    state[at[name]] = int(row[column]) if name == "lim" else bool(row[column])
            if row["seconds"] is not None:  # a string, as a NaN is a value here
                state[at["seconds"]] = float(row["seconds"])
            return None
        if row["rank"] == 1:
            for slot in ("w7", "w8", "user_led", "r", "g", "b"):
                if not _null(row[slot]):
                    state[at[slot]] = float(row[slot])
            if not _null(row["kind"]):
                stop = ticks(state[at["seconds"]]) if row["kind"] == "body" else 0 if _null(row["stop"]) else int(row["stop"])
                state[at["kind"]], state[at["counter"]], state[at["stop"]] = row["kind"], 0, stop
            return None
        state[at["n"]] += 1
        if state[at["stop"]] > 0:
            state[at["counter"]] += 1
            if state[at["counter"]] > state[at["stop"]]:
                state[at["counter"]] = 0
                state[at["w7"]] = state[at["w8"]] = 0.0
        if not state[at["arm"]]:
            state[at["w7"]] = state[at["w8"]] = 0.0
        get = lambda name: state[at[name]]
        return {
            "n": get("n"), "mode": (1.0 if get("kind") == "body" else 0.0) + (0.0 if get("lim") == 0 else 2.0),
            **{c: get(c) for c in ("user_led", "r", "g", "b")},
            "enable": float(get("arm")), "hold": float(get("hold")), "s7": get("w7"), "s8": get("w8"), "ts": row["ts"].value // 1000 / 1e6,
        }


def live(rows: DataFrame, processor: InOrder | Camera) -> DataFrame:
    """Rows with robot_id, ts and event_id, run through a processor; append mode."""
    return rows.groupBy("robot_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output(), outputMode="Append", timeMode="None"
    )


def reordered(rows: DataFrame, bound_ms: int, idle_ms: int | None = None) -> DataFrame:
    """Rows with robot_id, ts and event_id, put in order; see `Reorder`. `sinks.ordered_topics` parts them."""
    p = Reorder(rows.schema, bound_ms, idle_ms)
    return rows.groupBy("robot_id").transformWithStateInPandas(statefulProcessor=p, outputStructType=p.output(), outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")


def most_recent(rows: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """The newest row of each robot at each trigger; see `MostRecent`. Update mode."""
    p = MostRecent(rows.schema, ttl_ms)
    return rows.groupBy("robot_id").transformWithStateInPandas(statefulProcessor=p, outputStructType=p.output(), outputMode="Update", timeMode="ProcessingTime")


def request_rows(requests: DataFrame, lifecycle_rows: DataFrame) -> DataFrame:
    """One stream for `Replies`: lifecycle rows, and requests with what the reply is either way."""
    on = lifecycle.started(F.col("kind"), F.col("result"))
    states = lifecycle_rows.select("robot_id", "ts", "event_id", F.lit(0).alias("rank"), on.alias("on"))
    why = lambda running: lifecycle.reason(F.col("node"), F.col("changes"), F.lit(running))
    asked = params.sets(requests).select("robot_id", "ts", "event_id", F.lit(1).alias("rank"), why(True).alias("if_running"), why(False).alias("if_stopped"))
    return states.unionByName(asked, allowMissingColumns=True)


def driver_rows(changes: DataFrame, writes: DataFrame, tick_rows: DataFrame) -> DataFrame:
    """One stream of what a driver takes in: parameter changes as they are requested (alone or in
    sets, see `params.sets`), of which whole sets are validated here, write rows, and ticks."""
    said = params.accepted_values(changes, TIMED).withColumn("seconds", F.col("body_speed_duration").cast("string")).drop("body_speed_duration")
    return said.withColumn("rank", F.lit(0)).unionByName(writes.withColumn("rank", F.lit(1)), allowMissingColumns=True).unionByName(
        tick_rows.select("robot_id", "event_id", "ts", F.lit(2).alias("rank")), allowMissingColumns=True
    )


def latest_live(rows: DataFrame, period: str, late: str) -> DataFrame:
    """The last row of each robot and period of event time; a period is final once it lies ``late`` back."""
    t = rows.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late)
    whole = F.struct(*rows.columns)
    last = t.groupBy("robot_id", F.window("_t", period)).agg(F.max_by(whole, F.struct("ts", "event_id")).alias("_row"))
    return last.select(F.col("window.start").alias("bucket"), *(F.col("_row")[c].alias(c) for c in rows.columns))
