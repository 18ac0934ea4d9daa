"""The tick machine against the sequential model: edge tables, random logs, cut logs."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helmsight.plans import flows
from helmsight.schemas import BODY_COMMAND, JOINT_COMMAND, LED_COMMAND, PARAMETER
from simulator import DriverModel

T0 = dt.datetime(2024, 1, 1)


def run(spark, log, slices=None):
    """log: entries in order, ('tick',), ('body', x, z), ('jog', names, velocities, duration), ('led', r, g, b, a), ('set', name, value)."""
    at = [(1, i, T0 + dt.timedelta(hours=i)) for i in range(len(log))]
    pick = lambda kind: [(*a, *x[1:]) for a, x in zip(at, log, strict=True) if x[0] == kind]
    body = spark.createDataFrame(pick("body"), BODY_COMMAND)
    joint = spark.createDataFrame(pick("jog"), JOINT_COMMAND)
    led = spark.createDataFrame(pick("led"), LED_COMMAND)
    changes = spark.createDataFrame([(*a, "driver", x[1], str(x[2]).lower()) for a, x in zip(at, log, strict=True) if x[0] == "set"], PARAMETER)
    ticks = spark.createDataFrame([(*a,) for a, x in zip(at, log, strict=True) if x[0] == "tick"], "robot_id long, event_id long, ts timestamp_ntz")
    frames = flows.drive(ticks, flows.writes(body, led, joint), changes, slices)
    return [r.asDict() for r in frames.orderBy("n").collect()]


def model(log):
    m, out = DriverModel(), []
    for entry in log:
        if entry[0] == "tick":
            out.append(m.tick())
        elif entry[0] == "set":
            m.p[entry[1]] = entry[2]
        else:
            getattr(m, entry[0])(*entry[1:])
    return out


def agree(spark, log, slices=None):
    got, want = run(spark, log, slices), model(log)
    assert [g["n"] for g in got] == list(range(1, len(want) + 1))
    for g, w in zip(got, want, strict=True):
        assert {k: g[k] for k in w} == w
    return got


TICK = ("tick",)


def test_default_timeout(spark):
    got = agree(spark, [("body", 1.0, 2.0)] + [TICK] * 40)
    assert [g["n"] for g in got if g["s7"] != 0] == list(range(1, 32))


@pytest.mark.parametrize("seconds, held", [(0.0, 5), (0.007, 5), (0.008, 1), (-1.0, 5)])
def test_short_durations(spark, seconds, held):
    got = agree(spark, [("jog", ["left_wheel"], [3.0], seconds)] + [TICK] * 5)
    assert sum(g["s7"] != 0 for g in got) == held


def test_edge_tables(spark):
    log = [
        ("body", 1.0, 2.0), TICK, ("set", "arm_robot", False), TICK, ("set", "arm_robot", True), TICK,  # stays zero after arming again
        ("body", 4.0, 5.0), TICK, ("jog", ["left_wheel"], [6.0], 1.0), TICK,  # the other slot keeps the body value
        ("jog", ["caster"], [9.0], 0.02), TICK,  # no effect at all
        ("jog", ["left_wheel", "right_wheel", "left_wheel"], [1.0, 2.0, 3.0], 1.0), TICK,  # the last one wins
        ("body", 7.0, 7.0), ("jog", ["right_wheel"], [8.0], 0.032), ("led", 0.1, 0.2, 0.3, 0.0), TICK, TICK, TICK, TICK,  # LED outlives the timeout
        ("jog", ["left_wheel", "right_wheel"], [2.0], 1.0), TICK,  # a name without a velocity writes nothing
        ("set", "speed_limit_mode", 1), ("set", "hold", True), TICK, ("body", 1.0, 1.0), TICK, ("body", 9.9, 9.9),
    ]
    got = agree(spark, log)
    assert got[2]["s7"] == 0 and got[3]["s8"] == 5.0 and got[4]["mode"] == 0 and got[4]["s8"] == 5.0
    assert got[6]["s7"] == 3.0 and got[-1]["mode"] == 3.0 and got[-1]["hold"] == 1.0


def test_no_commands(spark):
    got = agree(spark, [TICK, TICK])
    assert (got[0]["user_led"], got[0]["r"], got[0]["g"], got[0]["b"]) == (1.0, 0.0, 0.0, 1.0)


entries = st.one_of(
    st.just(TICK), st.just(TICK), st.just(TICK),
    st.tuples(st.just("body"), st.integers(1, 9).map(float), st.integers(1, 9).map(float)),
    st.tuples(st.just("jog"), st.lists(st.sampled_from(["left_wheel", "right_wheel", "Left_wheel"]), max_size=3), st.lists(st.integers(1, 9).map(float), min_size=3, max_size=3), st.sampled_from([0.0, 0.016, 0.04, 0.1])),
    st.tuples(st.just("led"), *[st.sampled_from([0.0, 0.5, 1.0])] * 4),
    st.tuples(st.just("set"), st.sampled_from(["arm_robot", "hold"]), st.booleans()),
    st.tuples(st.just("set"), st.just("body_speed_duration"), st.sampled_from([0.0, 0.02, 0.05])),
    st.tuples(st.just("set"), st.just("speed_limit_mode"), st.sampled_from([0, 1])),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(entries, min_size=5, max_size=60))
def test_random_logs(spark, log):
    got = agree(spark, log)
    assert all(g["s7"] == g["s8"] == 0 for g in got if g["enable"] == 0)


def test_cut_log(spark):
    """However a log is cut, the result is that of the whole."""
    log = ([("body", 1.0, 2.0)] + [TICK] * 9 + [("set", "arm_robot", False), TICK, ("set", "arm_robot", True), ("jog", ["left_wheel"], [3.0], 0.2)] + [TICK] * 30) * 2
    for slices in (2, 7, 40):
        agree(spark, log, slices)
