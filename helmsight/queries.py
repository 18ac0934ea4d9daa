"""Registered queries, one or more per operator of the inventory, and their SQL.

Names start with the operator's id. SQL and DataFrame code are written apart: the SQL
states the meaning with plain windows over the whole log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.constants import IMAGE_DEPTH, JOYSTICK_MS, STREAM_BUFFER, TICK_MS, TOPIC_DEPTH
from .functions.running import Sum, running, sliced
from .operators import commands, driver, gamepad, imaging, lifecycle, logs, params, routing, status, telemetry
from .plans import flows
from .schemas import TELEMETRY, TELEMETRY_SLOTS
from .sources import events as ev
from .sources import topics

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ------------------------------------------------------------------ SQL building blocks

E = """e AS (
  SELECT event_id, ts, user_id AS robot_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""

SLOTS_SQL = {
    "enc0": "value * 2e0", "enc1": "value * 3e0", "tach0": "value / 50e0", "tach1": "(CAST(k AS DOUBLE) - 50e0) / 10e0", "volt0": "value / 100e0", "volt1": "CAST(k AS DOUBLE) / 10e0",
    "acc_x": "value / 1000e0", "acc_y": "CAST(k AS DOUBLE) / 100e0", "acc_z": "value / 500e0", "gyro_x": "CAST(k AS DOUBLE) / 7e0", "gyro_y": "value / 11e0", "gyro_z": "CAST(k AS DOUBLE) - value",
    "cur0": "value / 13e0", "cur1": "CAST(k AS DOUBLE) / 3e0", "battery_v": "10e0 + CAST(k AS DOUBLE) / 50e0", "watchdog": "CASE WHEN k > 90 THEN 1e0 ELSE 0e0 END", "device_ts": "value + CAST(k AS DOUBLE)",
}
TEL = f"""tel AS (
  SELECT robot_id, event_id, ts, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'would_block' ELSE 'ok' END AS status,
         {", ".join(f"{x} AS {n}" for n, x in SLOTS_SQL.items())} FROM e)"""
W = "(PARTITION BY robot_id ORDER BY ts, event_id)"
UP = "(PARTITION BY robot_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
BEFORE = "(PARTITION BY robot_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PAD = """pad AS (
  SELECT robot_id, event_id, ts, -1e0 * ((CAST(k AS DOUBLE) - 50e0) / 50e0) + 0e0 AS lla, (CAST(k AS DOUBLE) - 60e0) / 40e0 AS rt,
         (20e0 - CAST(k AS DOUBLE)) / 20e0 AS lt, CAST(k % 2 AS INT) AS a, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS lb FROM e)"""
ARMED = f"""edge AS (
  SELECT *, CASE WHEN lb = 1 AND coalesce(lag(lb) OVER {W}, 0) = 0 THEN 1 ELSE 0 END AS edge FROM pad),
armed AS (SELECT *, sum(edge) OVER {UP} % 2 = 1 AS armed FROM edge)"""
MOTION = """motion AS (
  SELECT *, CASE WHEN NOT armed THEN 0e0 WHEN rt > 0 THEN 0.8e0 * (0.5e0 + 0.5e0 * rt) WHEN lt > 0 THEN -0.8e0 * (0.5e0 + 0.5e0 * lt) ELSE 0e0 END AS throttle,
         CASE WHEN NOT armed THEN 0e0 WHEN NOT rt > 0 AND lt > 0 THEN -2.5e0 * lla + 0e0 ELSE 2.5e0 * lla + 0e0 END AS steering FROM armed)"""
#: as written by the adapter: parameter changes and commands
CHANGES = """chg AS (
  SELECT robot_id, event_id, ts, 'arm_robot' AS name, CASE WHEN k >= 30 THEN 'true' ELSE 'false' END AS value FROM e WHERE event_type = 'signup'
  UNION ALL SELECT robot_id, event_id, ts, 'hold', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END FROM e WHERE event_type = 'signup'
  UNION ALL SELECT robot_id, event_id, ts, 'speed_limit_mode', CAST(k % 3 - CASE WHEN k > 80 THEN 1 ELSE 0 END AS VARCHAR) FROM e WHERE event_type = 'view'
  UNION ALL SELECT robot_id, event_id, ts, 'body_speed_duration', CAST((k % 8) * 0.02e0 AS VARCHAR) FROM e WHERE event_type = 'click')"""
WRITES = """wr AS (
  SELECT robot_id, event_id, ts,
         CASE WHEN event_type = 'click' THEN value WHEN event_type = 'purchase' AND k % 4 IN (0, 1) THEN value END AS w7,
         CASE WHEN event_type = 'click' THEN value / 10e0 WHEN event_type = 'purchase' AND k % 4 IN (0, 2) THEN -value END AS w8,
         CASE WHEN event_type = 'click' THEN 'body' WHEN event_type = 'purchase' AND k % 4 <> 3 THEN 'wheel' END AS kind,
         CASE WHEN event_type = 'click' OR event_type = 'purchase' AND k % 4 <> 3 THEN CAST(round(((k % 8) * 0.02e0) * 1000e0 / 16e0) AS INT) END AS stop,
         CASE WHEN event_type = 'error' THEN CAST(k % 2 AS DOUBLE) END AS user_led, CASE WHEN event_type = 'error' THEN k / 100e0 END AS r,
         CASE WHEN event_type = 'error' THEN (100 - k) / 100e0 END AS g, CASE WHEN event_type = 'error' THEN 0.5e0 END AS b
  FROM e WHERE event_type IN ('click', 'purchase', 'error'))"""
#: Commands come before the tick of their own row, so a tick sees those of rows up to its own.
FRAMES = f"""par AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN k >= 30 END AS p_arm, CASE WHEN event_type = 'signup' THEN k % 2 = 0 END AS p_hold,
         CASE WHEN event_type = 'view' AND k % 3 - CASE WHEN k > 80 THEN 1 ELSE 0 END IN (0, 1) THEN k % 3 - CASE WHEN k > 80 THEN 1 ELSE 0 END END AS p_mode FROM e),
seen AS (
  SELECT par.robot_id, par.event_id, par.ts, par.event_type, wr.w7, wr.w8, wr.kind, wr.stop, wr.user_led, wr.r, wr.g, wr.b,
         coalesce(last_value(p_arm IGNORE NULLS) OVER u, true) AS arm, coalesce(last_value(p_hold IGNORE NULLS) OVER u, false) AS hold,
         coalesce(last_value(p_mode IGNORE NULLS) OVER u, 0) AS lim, CASE WHEN is_tick THEN 1 ELSE 0 END AS tick
  FROM (SELECT *, {{tick}} AS is_tick FROM par) par LEFT JOIN wr USING (robot_id, event_id)
  WINDOW u AS (PARTITION BY par.robot_id ORDER BY par.ts, par.event_id ROWS UNBOUNDED PRECEDING)),
num AS (SELECT *, coalesce(sum(tick) OVER {BEFORE}, 0) + 1 AS n FROM seen),
fol AS (
  SELECT robot_id, n, max(event_id) FILTER (tick = 1) AS event_id, max(ts) FILTER (tick = 1) AS ts, bool_or(arm) FILTER (tick = 1) AS arm,
         bool_or(hold) FILTER (tick = 1) AS hold, max(lim) FILTER (tick = 1) AS lim,
         {", ".join(f"arg_max({c}, event_id) FILTER ({c} IS NOT NULL) AS {c}" for c in ("w7", "w8", "kind", "stop", "user_led", "r", "g", "b"))}
  FROM num GROUP BY robot_id, n HAVING max(tick) = 1),
cmd AS (
  SELECT *, last_value(CASE WHEN kind IS NOT NULL THEN n END IGNORE NULLS) OVER {UP} AS n0, last_value(stop IGNORE NULLS) OVER {UP} AS stop0,
         last_value(kind IGNORE NULLS) OVER {UP} AS kind0,
         {", ".join(f"last_value({c} IGNORE NULLS) OVER {UP} AS l_{c}" for c in ("user_led", "r", "g", "b"))} FROM fol),
out_ AS (SELECT *, coalesce(stop0 > 0 AND n - n0 + 1 > stop0, false) AS timed_out FROM cmd),
x AS (SELECT *, CASE WHEN timed_out OR NOT arm THEN 0e0 ELSE w7 END AS x7, CASE WHEN timed_out OR NOT arm THEN 0e0 ELSE w8 END AS x8 FROM out_),
frames AS (
  SELECT robot_id, CAST(n AS BIGINT) AS n, event_id, CASE WHEN kind0 = 'body' THEN 1e0 ELSE 0e0 END + CASE WHEN lim = 0 THEN 0e0 ELSE 2e0 END AS mode,
         coalesce(l_user_led, 1e0) AS user_led, coalesce(l_r, 0e0) AS r, coalesce(l_g, 0e0) AS g, coalesce(l_b, 1e0) AS b,
         CASE WHEN arm THEN 1e0 ELSE 0e0 END AS enable, CASE WHEN hold THEN 1e0 ELSE 0e0 END AS hold,
         coalesce(last_value(x7 IGNORE NULLS) OVER {UP}, 0e0) AS s7, coalesce(last_value(x8 IGNORE NULLS) OVER {UP}, 0e0) AS s8,
         epoch_us(ts) / 1e6 AS ts, timed_out FROM x)"""
#: every row a tick, or (between) rows that are no speed command
FORM_A = FRAMES.format(tick="true")
FORM_B = FRAMES.format(tick="event_type IN ('view', 'error', 'signup')")
DEPTH = """d AS (
  SELECT vec_id % 5 AS robot_id, vec_id AS image_id,
         CASE WHEN label = 0 THEN 'no_frame' WHEN label = 1 AND vec_id % 2 = 0 THEN 'data_error' ELSE 'ok' END AS raw_status,
         list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) - floor(CAST(x AS DOUBLE))) * 65535e0) AS INT)) AS raw FROM embeddings),
depth AS (SELECT robot_id, image_id, raw_status AS status, CASE WHEN raw_status = 'ok' THEN raw END AS pixels FROM d)"""
COLOR = f"""{DEPTH},
color AS (
  SELECT robot_id, image_id, CASE image_id % 7 WHEN 0 THEN 'no_frame' WHEN 1 THEN 'data_error' ELSE 'ok' END AS status,
         CASE WHEN image_id % 7 > 1 THEN list_transform(raw, lambda p: p >> 8) END AS upper FROM d)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _telemetry(s: SparkSession, d: str) -> DataFrame:
    return ev.telemetry(ev.events(s, d))


def _armed(s: SparkSession, d: str) -> DataFrame:
    e = ev.events(s, d)
    return gamepad.with_armed(gamepad.decoded(ev.gamepad(e)))


# ------------------------------------------------------------------------------ sources


@query("src1_telemetry_source", sql(E, TEL, select=f"SELECT robot_id, event_id, ts, status, {', '.join(TELEMETRY_SLOTS)} FROM tel"))
def _(s, d):
    return _telemetry(s, d)


@query("src2_poll_status", sql(E, TEL, select="SELECT robot_id, status, count(*) AS n FROM tel GROUP BY ALL"))
def _(s, d):
    return _telemetry(s, d).groupBy("robot_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src3_command_topics",
    sql(
        E,
        select="SELECT robot_id, event_id, ts, CASE event_type WHEN 'click' THEN 'cmd_vel' WHEN 'purchase' THEN 'joint_speed_cmd' ELSE 'led_strip' END AS topic, "
        "CASE WHEN event_type = 'click' THEN value END AS linear_x, CASE WHEN event_type = 'purchase' THEN (k % 8) * 0.02e0 END AS duration, "
        "CASE WHEN event_type = 'error' THEN k / 100e0 END AS r FROM e WHERE event_type IN ('click', 'purchase', 'error')",
    ),
)
def _(s, d):
    e = ev.events(s, d)
    return topics.command_topics(ev.body_commands(e), ev.joint_commands(e), ev.led_commands(e)).select("robot_id", "event_id", "ts", "topic", "linear_x", "duration", "r")


@query(
    "src4_gamepad_source",
    sql(
        E,
        select="SELECT robot_id, event_id, ts, (CAST(k AS DOUBLE) - 50e0) / 50e0 AS x, (20e0 - CAST(k AS DOUBLE)) / 20e0 AS z, (CAST(k AS DOUBLE) - 60e0) / 40e0 AS rz, "
        "CASE WHEN event_type IN ('click', 'view') THEN 16 ELSE 0 END + k % 2 AS buttons FROM e",
    ),
)
def _(s, d):
    return ev.gamepad(ev.events(s, d))


@query("src5_gamepad_poll", sql(E, select="SELECT robot_id, count(*) AS n_samples FROM e GROUP BY robot_id"))
def _(s, d):
    """Every sample counts, fresh or not."""
    return ev.gamepad(ev.events(s, d)).groupBy("robot_id").agg(F.count(F.lit(1)).alias("n_samples"))


@query("src6_color_source", sql(COLOR, select="SELECT robot_id, image_id, status, 8 AS height, 8 AS width, CAST(3 * len(upper) AS INT) AS n_bytes FROM color"))
def _(s, d):
    return ev.color_images(s, d).select("robot_id", "image_id", "status", "height", "width", F.length("data").alias("n_bytes"))


@query("src7_depth_source", sql(DEPTH, select="SELECT robot_id, image_id, status, list_max(pixels) AS highest, CAST(list_sum(pixels) AS BIGINT) AS total FROM depth"))
def _(s, d):
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p)
    return ev.depth_images(s, d).select("robot_id", "image_id", "status", F.array_max("pixels").alias("highest"), total.alias("total"))


@query("src8_next_frame", sql(DEPTH, select="SELECT status, count(*) AS n, count(pixels) AS n_payloads FROM depth GROUP BY status"))
def _(s, d):
    return ev.depth_images(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("pixels").alias("n_payloads"))


def _clock(e: DataFrame, period: int) -> DataFrame:
    n = running(sliced(e.withColumn("_one", F.lit(1)), ev.KEYS, ev.ORDER), ev.KEYS, ev.ORDER, n=Sum("_one"))
    return n.select("robot_id", "event_id", "n", ((F.col("n") - 1) * period).alias("nominal_ms"))


@query("src9_tick_clock", sql(E, select=f"SELECT robot_id, event_id, row_number() OVER {W} AS n, (row_number() OVER {W} - 1) * 16 AS nominal_ms FROM e"))
def _(s, d):
    return _clock(ev.events(s, d), TICK_MS)


@query("src10_joystick_timer", sql(E, select=f"SELECT robot_id, event_id, row_number() OVER {W} AS n, (row_number() OVER {W} - 1) * 100 AS nominal_ms FROM e"))
def _(s, d):
    return _clock(ev.gamepad(ev.events(s, d)), JOYSTICK_MS)


@query(
    "src11_parameters",
    """SELECT * FROM (VALUES
      ('driver', 'driver_uri', 'tcpip://localhost:18888'), ('driver', 'arm_robot', 'true'), ('driver', 'speed_limit_mode', '0'),
      ('driver', 'body_speed_duration', '0.5'), ('driver', 'hold', 'false'),
      ('camera', 'camera_num', '0'), ('camera', 'frame_width_rgb', '848'), ('camera', 'frame_height_rgb', '480'),
      ('camera', 'frame_width_depth', '1280'), ('camera', 'frame_height_depth', '720'), ('camera', 'frame_rate', '30.0')) AS t(node, name, value)""",
)
def _(s, d):
    return topics.declared_parameters(s)


# -------------------------------------------------------------------------- projections


@query(
    "prj1_forward_kinematics",
    sql(
        E,
        TEL,
        select="SELECT robot_id, event_id, (tach0 * (3.5e0 * 0.0254e0 / 2e0) + tach1 * (3.5e0 * 0.0254e0 / 2e0)) / 2e0 AS linear_x, "
        "(tach0 * (3.5e0 * 0.0254e0 / 2e0) - tach1 * (3.5e0 * 0.0254e0 / 2e0)) / 0.3928e0 AS angular_z FROM tel WHERE status = 'ok'",
    ),
)
def prj1(s: SparkSession, d: str) -> DataFrame:
    m = telemetry.speed_feedback(_telemetry(s, d))
    return m.select("robot_id", "event_id", F.col("twist.linear.x").alias("linear_x"), F.col("twist.angular.z").alias("angular_z"))


@query("prj2_constants", "SELECT 3.5e0 * 0.0254e0 / 2e0 AS wheel_radius, 0.3928e0 AS wheel_base")
def _(s, d):
    from .functions.constants import WHEEL_BASE, WHEEL_RADIUS

    return s.range(1).select(F.lit(WHEEL_RADIUS).alias("wheel_radius"), F.lit(WHEEL_BASE).alias("wheel_base"))


_UNKNOWN = ("temperature", "current", "charge", "capacity", "percentage")


@query(
    "prj3_battery",
    sql(
        E,
        TEL,
        select=f"SELECT robot_id, event_id, battery_v AS voltage, {', '.join(f'true AS {n}_is_nan' for n in _UNKNOWN)}, 7e0 AS design_capacity, 'DISCHARGING' AS power_supply_status, "
        "'GOOD' AS power_supply_health, 'LIPO' AS power_supply_technology, true AS present FROM tel WHERE status = 'ok'",
    ),
)
def _(s, d):
    m = telemetry.battery_state(_telemetry(s, d))
    known = ["voltage", "design_capacity", "power_supply_status", "power_supply_health", "power_supply_technology", "present"]
    return m.select("robot_id", "event_id", *known, *(F.isnan(n).alias(f"{n}_is_nan") for n in _UNKNOWN))


@query("prj4_imu", sql(E, TEL, select="SELECT robot_id, event_id, acc_x, acc_y, acc_z, gyro_x, gyro_y, gyro_z FROM tel WHERE status = 'ok'"))
def _(s, d):
    m = telemetry.imu(_telemetry(s, d))
    return m.select("robot_id", "event_id", *(F.col(f"linear_acceleration.{a}").alias(f"acc_{a}") for a in "xyz"), *(F.col(f"angular_velocity.{a}").alias(f"gyro_{a}") for a in "xyz"))


@query(
    "prj5_joint_state",
    sql(
        E,
        TEL,
        select="SELECT robot_id, event_id, enc0 AS position_0, enc1 AS position_1, tach0 AS velocity_0, tach1 AS velocity_1, cur0 AS effort_0, cur1 AS effort_1 FROM tel WHERE status = 'ok'",
    ),
)
def _(s, d):
    m = telemetry.joint_state(_telemetry(s, d))
    return m.select("robot_id", "event_id", *(F.get(c, F.lit(i)).alias(f"{c}_{i}") for c in ("position", "velocity", "effort") for i in (0, 1)))


@query("prj6_header", sql(E, TEL, select="SELECT event_id, topic, ts AS stamp, 'base_link' AS frame_id FROM tel, (VALUES ('speed_feedback'), ('battery'), ('imu'), ('joint')) t(topic) WHERE status = 'ok'"))
def prj6(s: SparkSession, d: str) -> DataFrame:
    return telemetry.messages(_telemetry(s, d)).select("event_id", "topic", F.col("header.stamp").alias("stamp"), F.col("header.frame_id").alias("frame_id"))


@query("prj7_fan_out", sql(E, TEL, select="SELECT topic, count(*) AS n FROM tel, (VALUES ('speed_feedback'), ('battery'), ('imu'), ('joint')) t(topic) WHERE status = 'ok' GROUP BY topic"))
def _(s, d):
    return prj6(s, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("prj8_unread_slots", "SELECT * FROM (VALUES ('volt0'), ('volt1'), ('watchdog'), ('device_ts')) t(slot)")
def _(s, d):
    """Slots that no message reads, taken from what the scans of the four messages would read of a frame table."""
    frames = topics.read_topic(s, f"{d}/events.parquet", TELEMETRY)
    read = set()
    for m in telemetry.fan_out(frames).values():
        scan = m._jdf.queryExecution().sparkPlan().collectLeaves().head()
        read |= set(scan.requiredSchema().fieldNames())
    return s.createDataFrame([(x,) for x in TELEMETRY_SLOTS if x not in read], "slot string")


# ------------------------------------------------------------------------------- routing


@query("flt1_received", sql(E, TEL, select="SELECT robot_id, event_id FROM tel WHERE status = 'ok'"))
def _(s, d):
    return routing.received(_telemetry(s, d)).select("robot_id", "event_id")


@query("flt2_would_block", sql(E, TEL, select="SELECT robot_id, event_id, nullif(status, 'would_block') AS counted FROM tel"))
def _(s, d):
    return _telemetry(s, d).select("robot_id", "event_id", routing.counted_status(F.col("status")).alias("counted"))


@query(
    "flt3_wheel_names",
    sql(
        E,
        select="SELECT robot_id, event_id, 'left_wheel' AS wheel, value AS velocity FROM e WHERE event_type = 'purchase' AND k % 4 IN (0, 1) "
        "UNION ALL SELECT robot_id, event_id, 'right_wheel', -value FROM e WHERE event_type = 'purchase' AND k % 4 IN (0, 2)",
    ),
)
def _(s, d):
    return routing.wheel_commands(ev.joint_commands(ev.events(s, d))).select("robot_id", "event_id", "wheel", "velocity")


@query("flt4_any_wheel", sql(E, select="SELECT robot_id, event_id, k % 4 <> 3 AS names_wheel FROM e WHERE event_type = 'purchase'"))
def _(s, d):
    return ev.joint_commands(ev.events(s, d)).select("robot_id", "event_id", routing.names_a_wheel(F.col("joint_names")).alias("names_wheel"))


@query("flt5_not_empty", sql(COLOR, select="SELECT 'color' AS stream, image_id FROM color WHERE len(upper) > 0 UNION ALL SELECT 'depth', image_id FROM depth WHERE len(pixels) > 0"))
def _(s, d):
    color = routing.with_image(ev.color_images(s, d), "data").select(F.lit("color").alias("stream"), "image_id")
    return color.unionByName(routing.with_image(ev.depth_images(s, d), "pixels").select(F.lit("depth").alias("stream"), "image_id"))


@query("flt6_armed_motion", sql(E, PAD, ARMED, MOTION, select="SELECT robot_id, event_id, armed, throttle AS linear_x FROM motion"))
def _(s, d):
    return gamepad.motion(_armed(s, d), also=(F.col("armed"),)).select("robot_id", "event_id", "armed", "linear_x")


# ------------------------------------------------------------------------------ commands


@query("cmd1_led", sql(E, WRITES, select="SELECT robot_id, event_id, user_led, r, g, b FROM wr WHERE user_led IS NOT NULL"))
def _(s, d):
    return commands.led_writes(ev.led_commands(ev.events(s, d))).select("robot_id", "event_id", "user_led", "r", "g", "b")


@query("cmd2_body_speed", sql(E, WRITES, select="SELECT robot_id, event_id, w7, w8, kind, stop FROM wr WHERE kind = 'body'"))
def _(s, d):
    e = ev.events(s, d)
    timed = params.as_of(ev.body_commands(e), ev.parameter_sets(e), {"body_speed_duration": "double"})
    return commands.body_writes(timed).select("robot_id", "event_id", "w7", "w8", "kind", "stop")


@query("cmd3_wheel_speed", sql(E, WRITES, select="SELECT wr.robot_id, event_id, w7, w8, stop FROM wr JOIN e USING (event_id) WHERE e.event_type = 'purchase' AND kind IS NOT NULL"))
def _(s, d):
    return commands.joint_writes_by_wheel(ev.joint_commands(ev.events(s, d))).select("robot_id", "event_id", "w7", "w8", "stop")


@query("cmd4_wheel_mode", sql(E, WRITES, select="SELECT wr.robot_id, event_id, w7, w8, kind, stop FROM wr JOIN e USING (event_id) WHERE e.event_type = 'purchase'"))
def _(s, d):
    return commands.joint_writes(ev.joint_commands(ev.events(s, d))).select("robot_id", "event_id", "w7", "w8", "kind", "stop")


@query("cmd5_duration_ticks", sql(E, select="SELECT event_id, CAST(round((k * 0.004e0 - 0.1e0) * 1000e0 / 16e0) AS INT) AS ticks FROM e"))
def _(s, d):
    return ev.events(s, d).select("event_id", commands.ticks(F.col("k") * 0.004 - 0.1).alias("ticks"))


# ------------------------------------------------------------------------------- gamepad


@query("joy1_axes", sql(E, PAD, select="SELECT robot_id, event_id, lla, rt, lt FROM pad"))
def _(s, d):
    return gamepad.decoded(ev.gamepad(ev.events(s, d))).select("robot_id", "event_id", "lla", "rt", "lt")


@query("joy2_buttons", sql(E, PAD, select="SELECT robot_id, event_id, a, lb FROM pad"))
def _(s, d):
    return gamepad.decoded(ev.gamepad(ev.events(s, d))).select("robot_id", "event_id", "a", "lb")


@query("joy3_toggle", sql(E, PAD, ARMED, select="SELECT robot_id, event_id, armed FROM armed"))
def _(s, d):
    return _armed(s, d).select("robot_id", "event_id", "armed")


for _name, _where in {
    "joy4_forward": ("armed AND rt > 0", lambda: F.col("armed") & (F.col("rt") > 0)),
    "joy5_backward": ("armed AND NOT rt > 0 AND lt > 0", lambda: F.col("armed") & ~(F.col("rt") > 0) & (F.col("lt") > 0)),
    "joy6_turn_in_place": ("armed AND NOT rt > 0 AND NOT lt > 0", lambda: F.col("armed") & ~(F.col("rt") > 0) & ~(F.col("lt") > 0)),
    "joy7_unarmed": ("NOT armed", lambda: ~F.col("armed")),
}.items():

    @query(_name, sql(E, PAD, ARMED, MOTION, select=f"SELECT robot_id, event_id, throttle AS linear_x, steering AS angular_z FROM motion WHERE {_where[0]}"))
    def _(s, d, where=_where[1]):
        return gamepad.motion(_armed(s, d).filter(where())).select("robot_id", "event_id", "linear_x", "angular_z")


@query("joy8_led", sql(E, PAD, ARMED, select="SELECT robot_id, event_id, 0e0 AS r, CASE WHEN armed THEN 1e0 ELSE 0e0 END AS g, CASE WHEN armed THEN 0e0 ELSE 1e0 END AS b, 1e0 AS a FROM armed"))
def _(s, d):
    return gamepad.leds(_armed(s, d)).select("robot_id", "event_id", "r", "g", "b", "a")


@query("joy9_button_a", sql(E, PAD, select="SELECT robot_id, CAST(sum(a) AS BIGINT) AS n_pressed FROM pad GROUP BY robot_id"))
def _(s, d):
    """The flag is carried and changes nothing."""
    return gamepad.decoded(ev.gamepad(ev.events(s, d))).groupBy("robot_id").agg(F.sum("a").alias("n_pressed"))


@query("joy10_emit", sql(E, PAD, ARMED, MOTION, select="SELECT event_id, throttle AS linear_x, steering AS angular_z, CASE WHEN armed THEN 1e0 ELSE 0e0 END AS led_g FROM motion"))
def _(s, d):
    """Both messages of a sample come from one row."""
    both = gamepad.motion(_armed(s, d), also=gamepad.led_columns(F.col("armed")))
    return both.select("event_id", "linear_x", "angular_z", F.col("g").alias("led_g"))


# ------------------------------------------------------------------- driver state machine


def _form(s: SparkSession, d: str, between: bool, slices: int | None = None) -> DataFrame:
    e = ev.events(s, d)
    changes = ev.parameter_sets(e)
    writes = flows.writes(ev.body_commands(e), ev.led_commands(e), ev.joint_commands(e))
    ticks = e.filter("event_type in ('view', 'error', 'signup')") if between else e
    return flows.drive(ticks.select("robot_id", "event_id", "ts"), writes, changes, slices)


@query("st1_mode", sql(E, WRITES, FORM_A, select="SELECT robot_id, n, event_id, mode FROM frames"))
def _(s, d):
    return _form(s, d, False).select("robot_id", "n", "event_id", "mode")


def _edges(status_sql: str, error: str, fine: str) -> str:
    return sql(
        E,
        TEL,
        f"now AS (SELECT *, {status_sql} AS now FROM tel)",
        f"was AS (SELECT *, last_value(now IGNORE NULLS) OVER {BEFORE} AS was FROM now)",
        select=f"SELECT robot_id, event_id, ts, CASE WHEN now = 'ok' THEN 'recovered' ELSE 'error' END AS edge, CASE WHEN now = 'ok' THEN '{fine}' ELSE '{error}' END AS message "
        "FROM was WHERE now IS NOT NULL AND now <> coalesce(was, 'ok')",
    )


@query("st2_receive_edges", _edges("nullif(status, 'would_block')", "error receiving data", "data received"))
def st2(s: SparkSession, d: str) -> DataFrame:
    t = _telemetry(s, d)
    return status.status_edges(t, routing.counted_status(F.col("status")))


@query("st3_send_edges", _edges("CASE WHEN status = 'ok' THEN 'ok' ELSE 'fail' END", "error sending data", "data sent"))
def st3(s: SparkSession, d: str) -> DataFrame:
    """Every failure counts, would-block too; the fixture's receive status stands in for the send status."""
    t = _telemetry(s, d)
    return status.status_edges(t, F.when(F.col("status") == "ok", "ok").otherwise("fail"), say=status.SEND)


RESULTS = """res AS (
  SELECT robot_id, event_id, ts, CASE event_type WHEN 'error' THEN -1 - k % 7 WHEN 'view' THEN -34 ELSE 0 END AS received,
         CASE WHEN k % 20 = 13 THEN -34 WHEN k % 10 = 3 THEN -1 - k % 4 ELSE 0 END AS sent FROM e)"""


def _link_sql(result: str, silent: str, doing: str, done: str) -> str:
    return f"""SELECT robot_id, 'driver' AS node, event_id AS at, 'INFO' AS severity, code,
      CASE WHEN ok THEN '{done} driver model.' ELSE 'Error (' || code || ') {doing} driver model. Make sure the driver model is running.' END AS message
    FROM (SELECT *, last_value(ok IGNORE NULLS) OVER {BEFORE} AS was FROM (SELECT *, CAST({result} AS INT) AS code, CASE WHEN NOT ({silent}) THEN {result} >= 0 END AS ok FROM res))
    WHERE ok IS NOT NULL AND ok <> coalesce(was, true)"""


_RECEIVE_LOG = _link_sql("received", "received = -34", "receiving data from", "Data received from")
_SEND_LOG = _link_sql("sent", "false", "sending data to", "Data sent to")


@query("st3_send_outcomes", sql(E, RESULTS, select=_SEND_LOG))
def _(s, d):
    """Edges of the results of sends, with their codes; one that would have blocked is an error here."""
    return logs.send_log(ev.link_results(ev.events(s, d)), F.col("sent"))


@query("flt2_results", sql(E, RESULTS, select=_RECEIVE_LOG))
def _(s, d):
    """Edges of the results of reads, with their codes; those that would have blocked say nothing."""
    return logs.receive_log(ev.link_results(ev.events(s, d)), F.col("received"))


@query("st4_timeout", sql(E, WRITES, FORM_A, select="SELECT robot_id, n, timed_out, s7, s8 FROM frames"))
def _(s, d):
    return _form(s, d, False).select("robot_id", "n", "timed_out", "s7", "s8")


@query("st5_hold", sql(E, WRITES, FORM_A, select="SELECT robot_id, n, hold FROM frames"))
def _(s, d):
    return _form(s, d, False).select("robot_id", "n", "hold")


@query("st6_arm_gate", sql(E, WRITES, FORM_A, select="SELECT robot_id, n, enable, s7, s8 FROM frames WHERE enable = 0"))
def _(s, d):
    return _form(s, d, False).filter("enable = 0").select("robot_id", "n", "enable", "s7", "s8")


@query(
    "st7_parameters_as_of",
    sql(
        E,
        WRITES,
        FORM_A,
        select="SELECT robot_id, event_id, arm AS arm_robot, hold, CAST(lim AS INT) AS speed_limit_mode FROM seen",
    ),
)
def _(s, d):
    e = ev.events(s, d)
    return params.as_of(e.select("robot_id", "event_id", "ts"), ev.parameter_sets(e), driver.PARAMETERS).drop("ts")


_FRAME = "SELECT robot_id, n, event_id, mode, user_led, r, g, b, enable, hold, s7, s8, ts, timed_out FROM frames"


@query("st8_command_frames", sql(E, WRITES, FORM_A, select=_FRAME))
def _(s, d):
    return _form(s, d, False)


@query("st8_commands_between_ticks", sql(E, WRITES, FORM_B, select=_FRAME))
def _(s, d):
    return _form(s, d, True)


@query("st8_chunked_log", sql(E, WRITES, FORM_B, select=_FRAME))
def _(s, d):
    """The same by a prefix scan over 64 even slices of the whole log, as for robots with too many rows for one task."""
    return _form(s, d, True, 64)


# -------------------------------------------------------------------------------- images


@query("img1_matrix", sql(DEPTH, select="SELECT image_id, pixels[3 * 8 + 5 + 1] AS p_3_5, pixels[7 * 8 + 7 + 1] AS p_7_7 FROM depth"))
def _(s, d):
    at = lambda i, j: imaging.pixel(F.col("pixels"), F.col("width"), F.lit(i), F.lit(j)).alias(f"p_{i}_{j}")
    return ev.depth_images(s, d).select("image_id", at(3, 5), at(7, 7))


_UP = "(PARTITION BY robot_id ORDER BY image_id ROWS UNBOUNDED PRECEDING)"
_FILL = f"fill AS (SELECT *, last_value(CASE WHEN status = 'ok' THEN pixels END IGNORE NULLS) OVER {_UP} AS shown FROM depth)"


@query(
    "img2_encode",
    sql(COLOR, select="SELECT image_id, 'bgr8' AS encoding, image_id AS stamp, 'color_image' AS frame_id, upper[3 * 8 + 5 + 1] AS red_3_5 FROM color WHERE status = 'ok'"),
)
def _(s, d):
    m = _color_messages(s, d).filter(~F.col("is_filled"))
    return m.select("image_id", "encoding", "stamp", "frame_id", imaging.channel(F.col("data"), F.col("width"), F.lit(3), F.lit(5), 2).alias("red_3_5"))


def _depth_messages(s: SparkSession, d: str, slices: int | None = None) -> DataFrame:
    return imaging.gap_filled(ev.depth_images(s, d), "pixels", "depth_image", "mono16", slices)


def _color_messages(s: SparkSession, d: str) -> DataFrame:
    return imaging.gap_filled(ev.color_images(s, d), "data", "color_image", "bgr8")


def _depth_references(s: SparkSession, d: str) -> DataFrame:
    return imaging.references(ev.depth_images(s, d), "depth_image", "mono16")


def _color_references(s: SparkSession, d: str) -> DataFrame:
    return imaging.references(ev.color_images(s, d), "color_image", "bgr8")


@query("img3_gap_fill", sql(DEPTH, _FILL, select="SELECT robot_id, image_id, CAST(list_sum(shown) AS BIGINT) AS total, status = 'no_frame' AS is_filled FROM fill WHERE status <> 'data_error'"))
def _(s, d):
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p)
    return _depth_messages(s, d).select("robot_id", "image_id", total.alias("total"), "is_filled")


@query("img3_gap_fill_chunked", sql(DEPTH, _FILL, select="SELECT robot_id, image_id, CAST(list_sum(shown) AS BIGINT) AS total FROM fill WHERE status <> 'data_error'"))
def _(s, d):
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p)
    return _depth_messages(s, d, 8).select("robot_id", "image_id", total.alias("total"))


@query("img4_unset_header", sql(DEPTH, select="SELECT image_id, CASE WHEN status = 'ok' THEN image_id END AS stamp, CASE WHEN status = 'ok' THEN 'depth_image' ELSE '' END AS frame_id FROM depth WHERE status <> 'data_error'"))
def _(s, d):
    return _depth_references(s, d).select("image_id", "stamp", "frame_id")


@query("img5_data_errors", sql(DEPTH, select="SELECT robot_id, count(*) FILTER (status <> 'data_error') AS n_sent, count(*) FILTER (status = 'data_error') AS n_dropped FROM depth GROUP BY robot_id"))
def _(s, d):
    every = ev.depth_images(s, d).groupBy("robot_id").agg(F.count(F.lit(1)).alias("n"))
    sent = _depth_references(s, d).groupBy("robot_id").agg(F.count(F.lit(1)).alias("n_sent"))
    return every.join(sent, "robot_id").select("robot_id", "n_sent", (F.col("n") - F.col("n_sent")).alias("n_dropped"))


@query("img6_leading_empty", sql(DEPTH, _FILL, select="SELECT robot_id, image_id FROM fill WHERE status <> 'data_error' AND shown IS NULL"))
def _(s, d):
    return _depth_references(s, d).filter("shown is null").select("robot_id", "image_id")


@query("img7_independent_streams", sql(COLOR, select="SELECT 'color' AS stream, count(*) AS n FROM color WHERE status <> 'data_error' UNION ALL SELECT 'depth', count(*) FROM depth WHERE status <> 'data_error'"))
def _(s, d):
    """No pairing: two streams, each with its own gaps."""
    n = lambda name, df: df.groupBy(F.lit(name).alias("stream")).agg(F.count(F.lit(1)).alias("n"))
    return n("color", _color_references(s, d)).unionByName(n("depth", _depth_references(s, d)))


@query("img8_rate_limit", sql(DEPTH, select="SELECT robot_id, CAST(floor(image_id / 30e0) AS BIGINT) AS bucket, max(image_id) AS image_id FROM depth GROUP BY ALL"))
def _(s, d):
    return imaging.latest_per(ev.depth_images(s, d).select("robot_id", "image_id"), F.floor(F.col("image_id") / 30.0), ["image_id"]).select("robot_id", "bucket", "image_id")


# ------------------------------------------------------------------ validation and sinks


def _changes(s: SparkSession, d: str) -> DataFrame:
    """Sets of two changes, made of event rows."""
    e = ev.events(s, d)
    k = F.col("k")
    names = F.array(*(F.lit(n) for n in ("driver_uri", "speed_limit_mode", "body_speed_duration", "arm_robot", "hold", "no_such", "camera_num", "frame_rate")))
    one = lambda pos, at, value: F.struct(F.lit(pos).alias("pos"), F.get(names, at).alias("name"), value.cast("string").alias("value"))
    both = F.array(one(0, k % 8, k - 20), one(1, (k + F.col("event_id").cast("int")) % 8, F.when(k == 7, F.lit("NaN")).otherwise((k * 7.0).cast("string"))))
    return e.select(F.col("event_id").alias("batch"), F.when(k % 5 == 0, "camera").otherwise("driver").alias("node"), (k % 2 == 0).alias("is_running"), F.inline(both))


_CHG = """n8 AS (SELECT ['driver_uri', 'speed_limit_mode', 'body_speed_duration', 'arm_robot', 'hold', 'no_such', 'camera_num', 'frame_rate'] AS names),
raw AS (
  SELECT event_id AS batch, CASE WHEN k % 5 = 0 THEN 'camera' ELSE 'driver' END AS node, k % 2 = 0 AS is_running, 0 AS pos, names[k % 8 + 1] AS name, CAST(k - 20 AS DOUBLE) AS v FROM e, n8
  UNION ALL SELECT event_id, CASE WHEN k % 5 = 0 THEN 'camera' ELSE 'driver' END, k % 2 = 0, 1, names[(k + event_id) % 8 + 1], CASE WHEN k = 7 THEN CAST('NaN' AS DOUBLE) ELSE k * 7e0 END FROM e, n8),
val AS (
  SELECT *, CASE
    WHEN node = 'camera' AND name IN ('camera_num', 'frame_rate') THEN CASE WHEN is_running THEN 'Cannot change this parameter while node is running.' END
    WHEN node = 'camera' THEN 'The parameter is invalid.'
    WHEN name = 'driver_uri' THEN CASE WHEN is_running THEN 'Cannot change this parameter while node is running.' END
    WHEN name = 'speed_limit_mode' THEN CASE WHEN v NOT BETWEEN 0 AND 1 OR pos = 1 THEN 'speed_limit_mode must be between 0 and 1.' END
    WHEN name = 'body_speed_duration' THEN CASE WHEN v < 0 OR (v > 600 AND NOT isnan(v)) THEN 'body_speed_duration must be between 0 and 600 sec.' END
    WHEN name IN ('arm_robot', 'hold') THEN NULL
    ELSE 'The parameter is invalid.' END AS reason FROM raw)"""
#: second values come with decimals ("0.0"), so they are no integers and as modes are rejected


def _checked(s: SparkSession, d: str) -> DataFrame:
    return params.validated(_changes(s, d), F.col("is_running"))


for _name, _cond in {
    "val1_driver_uri": "node = 'driver' AND name = 'driver_uri'",
    "val2_speed_limit_mode": "node = 'driver' AND name = 'speed_limit_mode'",
    "val3_body_speed_duration": "node = 'driver' AND name = 'body_speed_duration'",
    "val4_unconstrained": "node = 'driver' AND name IN ('arm_robot', 'hold')",
    "val5_unknown": "name = 'no_such'",
    "val6_camera": "node = 'camera'",
}.items():

    @query(_name, sql(E, _CHG, select=f"SELECT batch, pos, name, reason, reason IS NULL AS ok FROM val WHERE {_cond}"))
    def _(s, d, cond=_cond):
        return _checked(s, d).filter(cond).select("batch", "pos", "name", "reason", "ok")


@query("val7_sets", sql(E, _CHG, select="SELECT batch, bool_and(reason IS NULL) AS successful, coalesce(arg_max(reason, pos) FILTER (reason IS NOT NULL), '') AS reason FROM val GROUP BY batch"))
def _(s, d):
    return params.batch_results(_checked(s, d))


@query("val8_no_size_check", sql(E, _CHG, select="SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS n_ok FROM val WHERE node = 'camera' AND name = 'frame_rate' AND NOT is_running"))
def _(s, d):
    """Any frame rate passes while the node does not run: combinations are not enforced."""
    rates = _checked(s, d).filter("node = 'camera' AND name = 'frame_rate' AND NOT is_running")
    return rates.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"))


_LIFE = f"""life AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN k % 4 <> 0 WHEN event_type = 'purchase' AND k % 5 = 0 THEN false END AS turned FROM e),
on_off AS (SELECT *, coalesce(last_value(turned IGNORE NULLS) OVER {UP}, false) AS is_running FROM life)"""
_REPLIES = """asked AS (
  SELECT *, CASE WHEN k % 5 = 0 THEN 'camera' ELSE 'driver' END AS node, ['driver_uri', 'speed_limit_mode', 'hold', 'no_such', 'camera_num'] AS names FROM on_off),
each AS (
  SELECT *, 0 AS pos, names[k % 5 + 1] AS name, k % 2 AS v FROM asked UNION ALL SELECT *, 1, names[(k + event_id) % 5 + 1], k % 4 FROM asked),
judged AS (
  SELECT *, CASE
    WHEN node = 'camera' AND name = 'camera_num' OR node = 'driver' AND name = 'driver_uri' THEN CASE WHEN is_running THEN 'Cannot change this parameter while node is running.' END
    WHEN node = 'driver' AND name = 'speed_limit_mode' THEN CASE WHEN v > 1 THEN 'speed_limit_mode must be between 0 and 1.' END
    WHEN node = 'driver' AND name = 'hold' THEN NULL
    ELSE 'The parameter is invalid.' END AS reason FROM each)"""


@query(
    "val7_replies",
    sql(E, _LIFE, _REPLIES, select="""SELECT robot_id, event_id, any_value(is_running) AS is_running, bool_and(reason IS NULL) AS successful,
      coalesce(arg_max(reason, pos) FILTER (reason IS NOT NULL), '') AS reason FROM judged GROUP BY robot_id, event_id"""),
)
def _(s, d):
    """Replies to requests, by whether the node runs as of each."""
    e = ev.events(s, d)
    return lifecycle.replies(ev.requests(e), ev.lifecycle(e))


@query("src1_gated_source", sql(E, TEL, _LIFE, select="SELECT tel.* FROM tel JOIN on_off USING (event_id) WHERE is_running"))
def _(s, d):
    """What a node takes in between a start that succeeds and a stop or a failed start."""
    e = ev.events(s, d)
    return lifecycle.gated(ev.telemetry(e), ev.lifecycle(e))


@query("src1_connect_log", sql(E, select="SELECT robot_id, 'driver' AS node, event_id AS at, 'INFO' AS severity, CAST(-1 - k % 3 AS INT) AS code, 'Error connecting stream: ' || (-1 - k % 3) AS message FROM e WHERE event_type = 'signup' AND k % 4 = 0"))
def _(s, d):
    starts = ev.lifecycle(ev.events(s, d)).filter("kind = 'start'")
    return logs.connect_log(starts, F.col("result"))


@query(
    "snk1_publish",
    sql(E, TEL, PAD, COLOR, select="SELECT 'telemetry' AS kind, 4 * count(*) FILTER (status = 'ok') AS n FROM tel UNION ALL SELECT 'gamepad', 2 * count(*) FROM pad "
        "UNION ALL SELECT 'camera', (SELECT count(*) FROM color WHERE status <> 'data_error') + (SELECT count(*) FROM depth WHERE status <> 'data_error')"),
)
def _(s, d):
    """Messages on the eight publishers, by node."""
    e = ev.events(s, d)
    of = lambda kind, df: df.select(F.lit(kind).alias("kind"))
    pad = ev.gamepad(e).select(F.explode(F.array(F.lit("cmd_vel"), F.lit("led_strip"))).alias("topic"))  # a sample makes one of each
    every = [of("telemetry", telemetry.messages(ev.telemetry(e))), of("gamepad", pad), of("camera", _color_references(s, d)), of("camera", _depth_references(s, d))]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("snk2_send", sql(E, WRITES, FORM_B, select="SELECT robot_id, count(*) AS n_sent, sum(s7) AS sum_s7, count(*) FILTER (enable = 0) AS n_disarmed FROM frames GROUP BY robot_id"))
def _(s, d):
    f = _form(s, d, True)
    return f.groupBy("robot_id").agg(F.count(F.lit(1)).alias("n_sent"), F.sum("s7").alias("sum_s7"), F.count(F.when(F.col("enable") == 0, 1)).alias("n_disarmed"))


@query("snk3_bounds", "SELECT * FROM (VALUES ('topic', 10), ('image', 1), ('stream', 1000)) t(queue, depth)")
def _(s, d):
    """Depths are declared, not enforced on rows; streams bound a micro-batch by files (sources.topics)."""
    return s.createDataFrame([("topic", TOPIC_DEPTH), ("image", IMAGE_DEPTH), ("stream", STREAM_BUFFER)], "queue string, depth int")


@query("snk4_most_recent", sql(E, select="SELECT robot_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS bucket, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM e GROUP BY ALL"))
def _(s, d):
    rows = ev.events(s, d).select("robot_id", "ts", "event_id", "value")
    return imaging.latest_per(rows, F.to_date("ts").cast("string"), ev.ORDER).select("robot_id", "bucket", "event_id", "value")


@query(
    "snk5_log",
    "WITH r AS (" + _edges("nullif(status, 'would_block')", "error receiving data", "data received") + "), w AS (" + _edges("CASE WHEN status = 'ok' THEN 'ok' ELSE 'fail' END", "error sending data", "data sent")
    + ") SELECT message, count(*) AS n FROM (SELECT message FROM r UNION ALL SELECT message FROM w) GROUP BY message",
)
def _(s, d):
    return st2(s, d).unionByName(st3(s, d)).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


CAMERA_RESULTS = """cam AS (
  SELECT 'rgb' AS stream, robot_id, image_id, status AS raw FROM color UNION ALL SELECT 'depth', robot_id, image_id, status FROM depth),
got AS (
  SELECT *, CASE WHEN raw = 'no_frame' AND image_id % 3 = 0 THEN 'stream_error' ELSE raw END AS status,
         CAST(CASE WHEN raw = 'no_frame' AND image_id % 3 = 0 THEN -2 - image_id % 4 WHEN raw = 'no_frame' THEN -34 WHEN raw = 'ok' THEN 0 ELSE -1 - image_id % 5 END AS INT) AS code FROM cam)"""
#: words for some of the fixture's codes
_WORDS = {-1: "out of memory", -2: "not connected"}


@query(
    "snk5_log_relation",
    sql(E, RESULTS, COLOR, CAMERA_RESULTS, f"rl AS ({_RECEIVE_LOG})", f"sl AS ({_SEND_LOG})",
        select="""SELECT * FROM rl UNION ALL SELECT * FROM sl UNION ALL
    SELECT robot_id, 'camera', image_id, 'ERROR', code, CASE status WHEN 'data_error' THEN 'Error getting data from ' || stream || ' frame: ' ELSE 'Error getting frame from ' || stream || ' stream: ' END
      || code || ' -> ' || CASE code WHEN -1 THEN 'out of memory' WHEN -2 THEN 'not connected' ELSE 'unspecified error' END
    FROM got WHERE status IN ('data_error', 'stream_error')"""),
)
def _(s, d):
    """What the driver and the camera log: edges of both directions of the link, and each camera error."""
    results, text = ev.link_results(ev.events(s, d)), logs.in_words(_WORDS)
    link = [logs.receive_log(results, F.col("received")), logs.send_log(results, F.col("sent"))]
    cameras = {"rgb": ev.color_images(s, d), "depth": ev.depth_images(s, d)}
    return logs.log(*link, *(logs.camera_log(ev.camera_results(images), stream, F.col("code"), text) for stream, images in cameras.items()))


@query(
    "img3_stream_errors",
    sql(COLOR, CAMERA_RESULTS, select="""SELECT stream, robot_id, image_id, last_value(CASE WHEN status = 'ok' THEN image_id END IGNORE NULLS) OVER (
      PARTITION BY stream, robot_id ORDER BY image_id ROWS UNBOUNDED PRECEDING) AS shown FROM got QUALIFY status = 'stream_error'"""),
)
def _(s, d):
    """Frames that an error kept back are filled as those that would have blocked are."""
    def shown(images, stream):
        rows = ev.camera_results(images)
        bad = rows.filter("status = 'stream_error'").select("robot_id", "image_id")
        return imaging.references(rows, stream, "").join(bad, ["robot_id", "image_id"], "left_semi").select(F.lit(stream).alias("stream"), "robot_id", "image_id", "shown")

    return shown(ev.color_images(s, d), "rgb").unionByName(shown(ev.depth_images(s, d), "depth"))


@query(
    "flow_manual_drive",
    sql(
        E,
        PAD,
        ARMED,
        MOTION,
        f"""wr AS (
  SELECT robot_id, event_id, ts, throttle AS w7, steering AS w8, 'body' AS kind,
         CAST(round(coalesce(last_value(CASE WHEN event_type = 'click' THEN (k % 8) * 0.02e0 END IGNORE NULLS) OVER {UP}, 0.5e0) * 1000e0 / 16e0) AS INT) AS stop,
         1e0 AS user_led, 0e0 AS r, CASE WHEN armed THEN 1e0 ELSE 0e0 END AS g, CASE WHEN armed THEN 0e0 ELSE 1e0 END AS b
  FROM motion JOIN (SELECT event_id, event_type, k FROM e) USING (event_id))""",
        FORM_B,
        select=_FRAME,
    ),
)
def flow_manual_drive(s: SparkSession, d: str) -> DataFrame:
    """Every event row is a gamepad sample; rows that are no speed command are ticks."""
    e = ev.events(s, d)
    ticks = e.filter("event_type in ('view', 'error', 'signup')").select("robot_id", "event_id", "ts")
    return flows.gamepad_to_frames(ev.gamepad(e), ticks, ev.parameter_sets(e))
