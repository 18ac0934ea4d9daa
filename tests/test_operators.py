"""Edge tables of the other operators."""

import datetime as dt
import math

from pyspark.sql import functions as F

from helmsight.functions.constants import WHEEL_RADIUS
from helmsight.operators import commands, gamepad, imaging, params, routing, status, telemetry
from helmsight.schemas import GAMEPAD, TELEMETRY, TELEMETRY_SLOTS
from simulator import edges, toggles

T0 = dt.datetime(2024, 1, 1)
KEY = "robot_id long, event_id long, ts timestamp_ntz"


def log(spark, values, schema):
    return spark.createDataFrame([(1, i, T0 + dt.timedelta(seconds=i), *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"{KEY}, {schema}")


def test_radius_is_the_computed_double():
    assert WHEEL_RADIUS == 0.044449999999999996


def test_frame_messages(spark):
    frames = spark.createDataFrame([(1, i, T0, s, *(float(x) for x in range(17))) for i, s in enumerate(["ok", "fail", "would_block"])], TELEMETRY)
    out = {k: v.collect() for k, v in telemetry.fan_out(frames).items()}
    assert all(len(v) == 1 for v in out.values())
    assert out["battery"][0].voltage == 14.0 and math.isnan(out["battery"][0].percentage)
    assert out["joint"][0].position == [0.0, 1.0] and out["joint"][0].effort == [12.0, 13.0]
    twist = out["speed_feedback"][0].twist
    assert twist.angular.z < 0 < twist.linear.x  # wheel 0, the slower one here, counts as the right one
    assert {r[0].header.frame_id for r in out.values()} == {"base_link"} and {r[0].header.stamp for r in out.values()} == {T0}
    assert len(TELEMETRY_SLOTS) == 17


def test_empty_tables(spark):
    frames = spark.createDataFrame([], TELEMETRY)
    assert all(m.count() == 0 for m in telemetry.fan_out(frames).values())
    assert status.status_edges(frames, F.col("status")).count() == 0
    twist, led = gamepad.manual_drive(spark.createDataFrame([], GAMEPAD))
    assert twist.count() == led.count() == 0


def test_toggle_and_branches(spark):
    presses = [0, 1, 1, 0, 1, 0, 1, 1]
    samples = spark.createDataFrame([(1, i, T0 + dt.timedelta(seconds=i), 0.0, 0.0, 0.0, 16 * p + 1) for i, p in enumerate(presses)], GAMEPAD)
    for slices in (1, 2, 5):
        got = [r.armed for r in gamepad.with_armed(gamepad.decoded(samples), slices).orderBy("event_id").collect()]
        assert got == toggles(presses)
    cases = [(0.5, 0.5, 0.6, -2.5 * 0.5), (0.0, 0.5, -0.6, 2.5 * 0.5), (0.0, 0.0, 0.0, -1.25), (-1.0, -1.0, 0.0, -1.25)]
    for rt, lt, throttle, steering in cases:
        one = spark.createDataFrame([(1, 0, T0, 0.5, lt, rt, 16)], GAMEPAD)
        r = gamepad.manual_drive(one)[0].first()
        assert math.isclose(r.linear_x, throttle) and math.isclose(r.angular_z, steering)
    zero = gamepad.manual_drive(spark.createDataFrame([(1, 0, T0, 0.0, 0.0, 0.0, 16)], GAMEPAD))[0].first()
    assert math.copysign(1, zero.angular_z) == 1  # no negative zero


def test_status_edges(spark):
    said = ["fail", "would_block", "fail", "ok", "ok", "would_block", "fail"]
    for slices in (1, 3):
        got = status.status_edges(log(spark, said, "status string"), routing.counted_status(F.col("status")), slices).orderBy("event_id").collect()
        assert [(r.event_id, r.edge) for r in got] == edges([None if s == "would_block" else s for s in said]) == [(0, "error"), (3, "recovered"), (6, "error")]
    assert status.status_edges(log(spark, ["ok", "ok"], "status string"), F.col("status")).count() == 0


def test_parameter_rules(spark):
    cases = [
        ("driver", "body_speed_duration", "0", False, None), ("driver", "body_speed_duration", "600", False, None), ("driver", "body_speed_duration", "600.1", False, params.BAD_DURATION),
        ("driver", "body_speed_duration", "-0.1", False, params.BAD_DURATION), ("driver", "body_speed_duration", "NaN", False, None),
        ("driver", "speed_limit_mode", "-1", False, params.BAD_MODE), ("driver", "speed_limit_mode", "0", False, None), ("driver", "speed_limit_mode", "1", True, None), ("driver", "speed_limit_mode", "2", False, params.BAD_MODE),
        ("driver", "driver_uri", "x", True, params.FROZEN), ("driver", "driver_uri", "x", False, None), ("driver", "arm_robot", "false", True, None),
        ("camera", "frame_rate", "30", True, params.FROZEN), ("camera", "frame_rate", "1e9", False, None), ("camera", "hold", "true", False, params.UNKNOWN), ("driver", "nope", "1", False, params.UNKNOWN),
    ]
    df = spark.createDataFrame([(i, i, *c) for i, c in enumerate(cases)], "batch int, pos int, node string, name string, value string, running boolean, want string")
    for r in params.validated(df, F.col("running")).collect():
        assert r.reason == r.want, r


def test_wrong_typed_mode_is_rejected(spark):
    values = ["7.0", "0.5", "NaN", "x", "", None, "1"]
    df = spark.createDataFrame(list(enumerate(values)), "batch int, value string").selectExpr("batch", "0 AS pos", "'driver' AS node", "'speed_limit_mode' AS name", "value")
    got = {r.value: r.reason for r in params.validated(df, F.lit(False)).collect()}
    assert got == {v: None if v == "1" else params.BAD_MODE for v in values}


def test_every_change_counts_in_its_set(spark):
    """No change is left out of val2 and val7, second values of the mode included."""
    import compare
    from helmsight import queries as reference

    sf, q = f"{compare.DATA}/sf0.001", reference.queries()
    every = reference._checked(spark, sf)
    assert q["val2_speed_limit_mode"](spark, sf).count() == every.filter("node = 'driver' AND name = 'speed_limit_mode'").count()
    rejected = {r.batch for r in every.filter("NOT ok").collect()}
    assert {r.batch for r in q["val7_sets"](spark, sf).filter("NOT successful").collect()} == rejected


def test_wrong_typed_duration_is_rejected(spark):
    values = ["x", "", None, "0.5", "NaN"]
    df = spark.createDataFrame(list(enumerate(values)), "batch int, value string").selectExpr("batch", "0 AS pos", "'driver' AS node", "'body_speed_duration' AS name", "value")
    assert {r.value: r.reason for r in params.validated(df, F.lit(False)).collect()} == {v: None if v in ("0.5", "NaN") else params.BAD_DURATION for v in values}


def test_sets_reach_rows_as_a_whole(spark):
    """A rejected change takes the others of its set with it."""
    rows = [(1, 0, T0, [("hold", "true"), ("speed_limit_mode", "7")]), (1, 1, T0, [("hold", "true"), ("speed_limit_mode", "1"), ("speed_limit_mode", "0")]), (1, 2, T0, [("arm_robot", "false"), ("driver_uri", "x")])]
    sets = spark.createDataFrame(rows, "robot_id long, event_id long, ts timestamp_ntz, changes array<struct<name: string, value: string>>")
    at = spark.createDataFrame([(1, i, T0) for i in range(3)], "robot_id long, event_id long, ts timestamp_ntz")
    got = [(r.hold, r.speed_limit_mode, r.arm_robot) for r in params.as_of(at, sets, {"hold": "boolean", "speed_limit_mode": "int", "arm_robot": "boolean"}).orderBy("event_id").collect()]
    assert got == [(False, 0, True), (True, 0, True), (True, 0, True)]


def test_slices_are_even_whatever_a_robot_holds(spark):
    """A robot with almost all rows, bursts at one time, a null robot and null orders: even slices, values of one window."""
    from helmsight.functions.running import Last, Sum, running, sliced, whole

    n = F.col("id")
    df = spark.range(20_000, numPartitions=8).select(
        F.when(n % 50 == 0, n % 7).when(n % 1999 == 0, None).otherwise(100).alias("robot_id"),
        F.when(n % 500 == 3, None).otherwise((n * 7919) % 300).alias("ts"), n.alias("event_id"),
        F.when(n % 37 == 0, n).alias("said"), (n % 3).alias("step"),
    )
    keys, order = ["robot_id"], ["ts", "event_id"]
    wanted = {"last": Last("said"), "was": Last("said", before=True), "total": Sum("step")}
    cut = sliced(df, keys, order, 16)
    sizes = [r["count"] for r in cut.filter("robot_id = 100").groupBy("_slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 2.5 * 20_000 / 16
    got, want = whole(running(cut, keys, order, **wanted)), running(df, keys, order, **wanted)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = running(cut, keys, order, **wanted)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # rows move once
    small = sliced(df, keys, order)
    assert small.columns == df.columns  # a task can take the whole: one window, and no job to find out


def test_empty_and_uncut_logs_have_no_slices(spark):
    from helmsight.functions.running import Last, running, sliced, whole

    for rows in ([], [(1, 1, 5)]):
        df = spark.createDataFrame(rows, "robot_id long, event_id long, said long")
        got = whole(running(sliced(df, ["robot_id"], ["event_id"], 8), ["robot_id"], ["event_id"], last=Last("said")))
        assert [r.last for r in got.collect()] == [r[2] for r in rows]


def test_sets_fail_together(spark):
    df = spark.createDataFrame([(1, 0, "hold", "true"), (1, 1, "speed_limit_mode", "5"), (1, 2, "nope", "1"), (2, 0, "hold", "true")], "batch int, pos int, name string, value string")
    got = {r.batch: (r.successful, r.reason) for r in params.batch_results(params.validated(df.withColumn("node", F.lit("driver")), F.lit(False))).collect()}
    assert got == {1: (False, params.UNKNOWN), 2: (True, "")}


def test_duplicate_and_missing_velocities(spark):
    j = log(spark, [(["left_wheel", "left_wheel"], [1.0, 2.0], 0.5), (["right_wheel", "left_wheel"], [1.0], 1e12), (["x"], [1.0], 0.5)], "joint_names array<string>, velocities array<double>, duration double")
    got = [(r.w7, r.w8, r.kind, r.stop) for r in commands.joint_writes(j).orderBy("event_id").collect()]
    assert got == [(2.0, None, "wheel", 31), (None, 1.0, "wheel", None), (None, None, None, None)]
    by_wheel = {r.event_id: (r.w7, r.w8) for r in commands.joint_writes_by_wheel(j).collect()}
    assert by_wheel == {0: (2.0, None), 1: (None, 1.0)}


def test_gap_fill(spark):
    rows = [(1, 0, "no_frame", None), (1, 1, "ok", [65535, 1]), (1, 2, "data_error", None), (1, 3, "no_frame", None), (1, 4, "ok", [2, 2])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "robot_id long, image_id long, status string, pixels array<int>, height int, width int")
    for slices in (1, 3):
        got = imaging.gap_filled(df, "pixels", "depth_image", "mono16", slices).orderBy("image_id").collect()
        assert [(r.image_id, r.pixels, r.stamp, r.frame_id, r.is_filled) for r in got] == [
            (0, None, None, "", True), (1, [65535, 1], 1, "depth_image", False), (3, [65535, 1], None, "", True), (4, [2, 2], 4, "depth_image", False),
        ]


def test_gaps_are_filled_by_reference(spark):
    """No payload goes through the window's exchange, and none is read where references are enough."""
    df = spark.createDataFrame([(1, 0, "ok", b"x", 1, 2)], "robot_id long, image_id long, status string, data binary, height int, width int")
    for slices in (1, 4):
        plan = imaging.gap_filled(df, "data", "color_image", "bgr8", slices)._jdf.queryExecution().optimizedPlan()
        found = plan.toString().splitlines()
        at = next(i for i, line in enumerate(found) if "Window [" in line)
        depth = found[at].index("Window")
        below = [line for line in found[at:] if line.startswith(found[at][: depth - 3].replace("+", " ").replace(":", " "))]
        assert not any("data#" in line for line in below if "LogicalRDD" not in line)
    thin = imaging.references(df, "color_image", "bgr8")._jdf.queryExecution().optimizedPlan().toString()
    assert "data#" not in thin.split("LogicalRDD")[0]
    # robots without an id have streams of their own; one image shown over and over
    rows = [(None, 0, "ok", b"n", 1, 1), (None, 1, "no_frame", None, 1, 1), (2, 0, "no_frame", None, 1, 1), (2, 1, "ok", b"y", 1, 1), *((2, i, "no_frame", None, 1, 1) for i in range(2, 9))]
    got = imaging.gap_filled(spark.createDataFrame(rows, df.schema), "data", "color_image", "bgr8", 3).collect()
    shown = {(r.robot_id, r.image_id): r.data and bytes(r.data) for r in got}
    assert len(got) == len(rows) and shown[None, 1] == b"n" and shown[2, 0] is None and all(shown[2, i] == b"y" for i in range(1, 9))


def test_latest_both_ways(spark):
    df = log(spark, [1.0, 2.0, 3.0, 4.0], "value double")
    day = F.floor(F.col("event_id") / 3)
    for f in (imaging.latest_per, imaging.latest_per_ranked):
        assert sorted(r.value for r in f(df, day, ["ts", "event_id"]).collect()) == [3.0, 4.0]


def test_plans(spark):
    """One exchange for the toggle, filters at the scan, no Python in batch operators."""
    from helmsight import queries as q
    from compare import DATA

    toggle = q.queries()["joy3_toggle"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert toggle.count("Exchange hashpartitioning") == 1 and "Python" not in toggle
    led = q.queries()["cmd1_led"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in led and "Exchange" not in led
