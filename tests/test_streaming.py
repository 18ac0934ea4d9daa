"""Streaming forms give what batch gives, over several micro-batches."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import DATA
from helmsight import queries as q
from helmsight.operators import gamepad, imaging, logs, routing, telemetry
from helmsight.plans import flows
from helmsight.schemas import COMMAND
from helmsight.sources import events as ev
from helmsight.sources.topics import stream_topic
from helmsight.streaming import processors, sinks

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def configured(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    processors.configure(spark)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def streamed(spark, df, tmp_path, batches=3, by="event_id"):
    """df as a stream of files that follow one another in the order of a column."""
    edges = df.approxQuantile(by, [i / batches for i in range(1, batches)], 0.0)
    low = float("-inf")
    for i, high in enumerate([*edges, float("inf")]):
        df.filter((F.col(by) > low) & (F.col(by) <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        low = high
    return stream_topic(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)


def finish(stream, name, tmp_path):
    w = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    run = w.start()
    run.awaitTermination()
    assert run.exception() is None
    return stream.sparkSession.table(name)


def equal(a, b, cols):
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_toggle(configured, tmp_path):
    pads = gamepad.decoded(ev.gamepad(ev.events(configured, SF)))
    got = finish(processors.live(streamed(configured, pads.select("robot_id", "event_id", "ts", "lb"), tmp_path), processors.Toggle()), "toggle", tmp_path)
    equal(got, q.queries()["joy3_toggle"](configured, SF), ["robot_id", "event_id", "armed"])


def test_status_edges(configured, tmp_path):
    t = ev.telemetry(ev.events(configured, SF)).select("robot_id", "event_id", "ts", routing.counted_status(F.col("status")).alias("now"))
    got = finish(processors.live(streamed(configured, t, tmp_path), processors.StatusEdges()), "edges", tmp_path)
    equal(got, q.queries()["st2_receive_edges"](configured, SF), ["robot_id", "event_id", "edge"])


FRAME = ["robot_id", "event_id", "n", "mode", "user_led", "r", "g", "b", "enable", "hold", "s7", "s8", "ts"]


def driver_stream(spark, tmp_path):
    """What a driver takes in, as three streams: requested sets, commands, ticks. Nothing is worked out in batch before."""
    e = streamed(spark, ev.events(spark, SF), tmp_path)
    writes = flows.writes(ev.body_commands(e), ev.led_commands(e), ev.joint_commands(e))
    return processors.driver_rows(ev.parameter_sets(e), writes, e)


def test_driver(configured, tmp_path):
    got = finish(processors.live(driver_stream(configured, tmp_path), processors.Driver()), "driver", tmp_path)
    equal(got, q.queries()["st8_command_frames"](configured, SF), FRAME)
    assert got.agg(F.max("late")).first()[0] == 0


def steps(spark, entries):
    """A robot's entries through the processor's steps, without a stream."""
    d, state, out = processors.Driver(), list(processors.Driver.START), []
    empty = {"arm_robot": None, "hold": None, "speed_limit_mode": None, "seconds": None, "kind": None, "stop": None, **dict.fromkeys(("w7", "w8", "user_led", "r", "g", "b"))}
    for i, entry in enumerate(entries):
        made = d.step(state, {**empty, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), **entry})
        if made:
            out.append(made)
    return out


@pytest.mark.parametrize("seconds, held", [("0.5", 31), ("0.0", 40), ("NaN", 40), ("0.04", 3), ("1e12", 40)])
def test_live_timeout_follows_the_parameter(configured, seconds, held):
    got = steps(configured, [{"rank": 0, "seconds": seconds}, {"rank": 1, "kind": "body", "w7": 1.0, "w8": 2.0}] + [{"rank": 2}] * 40)
    assert sum(g["s7"] != 0 for g in got) == held


def test_ties_count_and_late_rows_are_counted(configured, tmp_path):
    """Rows that are equal in order all count, in one micro-batch or over two; late ones are dropped and counted."""
    t = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    batches = [[(1, 5, t[1], 1), (1, 5, t[1], 0), (1, 5, t[1], 1), (2, 1, t[1], 1)], [(1, 5, t[1], 0), (1, 4, t[0], 1), (1, 6, t[2], 1)], [(1, 7, t[3], 1), (2, 2, t[2], 1)]]
    for i, rows in enumerate(batches):
        configured.createDataFrame(rows, "robot_id long, event_id long, ts timestamp_ntz, lb int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    s = stream_topic(configured, str(tmp_path / "in"), configured.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    got = finish(processors.live(s, processors.Toggle()), "ties", tmp_path)
    assert got.filter("robot_id = 1").count() == 6 and got.filter("robot_id = 2").count() == 2
    assert {(r.event_id, r.late) for r in got.collect() if r.robot_id == 1} == {(5, 0), (5, 1), (6, 1), (7, 1)}


def test_gap_fill(configured, tmp_path):
    d = ev.depth_images(configured, SF).withColumnRenamed("image_id", "event_id").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = finish(processors.live(streamed(configured, d.select("robot_id", "event_id", "ts", "status", "pixels"), tmp_path), processors.GapFill()), "gaps", tmp_path)
    want = q._depth_messages(configured, SF).withColumnRenamed("image_id", "event_id")
    text = lambda df: df.withColumn("pixels", F.col("pixels").cast("string"))
    equal(text(got), text(want), ["robot_id", "event_id", "pixels", "is_filled"])


def test_latest(configured, tmp_path):
    rows = ev.events(configured, SF).select("robot_id", "ts", "event_id", "value")
    got = finish(processors.latest_live(streamed(configured, rows, tmp_path), "1 day", "1 hour"), "latest", tmp_path)
    want = {(r.robot_id, r.bucket, r.event_id) for r in q.queries()["snk4_most_recent"](configured, SF).collect()}
    have = {(r.robot_id, str(r.bucket.date()), r.event_id) for r in got.collect()}
    last_day = max(b for _, b, _ in want)
    assert have <= want and {x for x in want if x[1] < last_day} <= have  # the last day is not final yet


def test_publish(configured, tmp_path):
    frames = ev.telemetry(ev.events(configured, SF))
    run = sinks.publish(streamed(configured, frames, tmp_path), telemetry.fan_out, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    for topic, want in telemetry.fan_out(frames).items():
        got = configured.read.parquet(str(tmp_path / "out" / topic))
        assert got.count() == want.count()


def published(stream, topics, tmp_path):
    run = sinks.publish(stream, topics, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.exception() is None
    return lambda topic: stream.sparkSession.read.parquet(str(tmp_path / "out" / topic))


def test_command_frames_are_sent(configured, tmp_path):
    read = published(processors.live(driver_stream(configured, tmp_path), processors.Driver()), sinks.command_topic, tmp_path)
    assert read("command").drop("batch").columns == COMMAND.fieldNames()
    equal(read("command"), q.queries()["st8_command_frames"](configured, SF), COMMAND.fieldNames())


def test_gamepad_topics_are_published(configured, tmp_path):
    pads = gamepad.decoded(ev.gamepad(streamed(configured, ev.events(configured, SF), tmp_path)))
    read = published(processors.live(pads, processors.ManualDrive()), sinks.gamepad_topics, tmp_path)
    twist, led = gamepad.manual_drive(ev.gamepad(ev.events(configured, SF)))
    equal(read("cmd_vel"), twist, ["robot_id", "event_id", "ts", "linear_x", "angular_z"])
    equal(read("led_strip"), led, ["robot_id", "event_id", "ts", "r", "g", "b", "a"])


def test_camera_topic_is_published(configured, tmp_path):
    d = ev.depth_images(configured, SF).withColumnRenamed("image_id", "event_id").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    stream = streamed(configured, d.select("robot_id", "event_id", "ts", "status", "pixels"), tmp_path)
    read = published(processors.live(stream, processors.GapFill()), sinks.camera_topic("depth"), tmp_path)
    want = q._depth_messages(configured, SF).withColumnRenamed("image_id", "event_id")
    text = lambda df: df.withColumn("pixels", F.col("pixels").cast("string"))
    cells = lambda df: {tuple(r) for r in text(df).select("robot_id", "event_id", "stamp", "frame_id", "pixels").collect()}
    assert cells(read("depth_image")) == cells(want)


def test_paced_batches_keep_their_distance(configured, tmp_path):
    """At most one micro-batch a period."""
    rows = ev.events(configured, SF).select("robot_id", "event_id", "ts")
    at = []
    writer = streamed(configured, rows, tmp_path).writeStream.foreachBatch(lambda batch, n: at.append(time.monotonic())).option("checkpointLocation", str(tmp_path / "ck"))
    run = sinks.paced(writer, 700).start()
    try:
        deadline = time.monotonic() + 60
        while len(at) < 3 and time.monotonic() < deadline:
            time.sleep(0.05)
    finally:
        run.stop()
    assert len(at) == 3 and all(b - a > 0.3 for a, b in zip(at[1:], at[2:]))


def camera_rows(spark):
    """Both streams of the fixture's cameras, as bytes."""
    color = ev.camera_results(ev.color_images(spark, SF)).select("robot_id", F.col("image_id").alias("event_id"), F.lit("color").alias("stream"), "status", "data", "height", "width")
    depth = ev.camera_results(ev.depth_images(spark, SF)).select("robot_id", F.col("image_id").alias("event_id"), F.lit("depth").alias("stream"), "status", imaging.depth_bytes(F.col("pixels")).alias("data"), "height", "width")
    return color.unionByName(depth)


def test_both_image_topics_are_published_from_one_processor(configured, tmp_path):
    rows = camera_rows(configured)
    assert {r.status for r in rows.select("status").distinct().collect()} == {"ok", "no_frame", "stream_error", "data_error"}
    stream = streamed(configured, rows, tmp_path, batches=4)
    read = published(processors.live(stream, processors.Camera()), sinks.camera_topics, tmp_path)
    for name, frame, encoding in (("color", "color_image", "bgr8"), ("depth", "depth_image", "mono16")):
        one = rows.filter(F.col("stream") == name).withColumnRenamed("event_id", "image_id")
        want = imaging.gap_filled(one, "data", frame, encoding).withColumnRenamed("image_id", "event_id")
        text = lambda df: df.withColumn("data", F.hex("data"))
        cells = lambda df: {tuple(r) for r in text(df).select("robot_id", "event_id", "stamp", "frame_id", "encoding", "data").collect()}
        got = read(frame)
        assert got.count() == want.count() and cells(got) == cells(want)


def test_depth_bytes(configured):
    df = configured.createDataFrame([([0, 1, 255, 256, 65535],), ([],), (None,)], "pixels array<int>")
    got = [r[0] and bytes(r[0]) for r in df.select(imaging.depth_bytes(F.col("pixels"))).collect()]
    assert got == [b"\x00\x00\x01\x00\xff\x00\x00\x01\xff\xff", bytearray(), None]


def test_send_outcomes_make_edges_and_survive_a_restart(configured, tmp_path):
    """A device that fails for some ticks: each frame tried once, one error and one recovery a robot, also when the stream is run anew."""
    tried = tmp_path / "tried"
    tried.mkdir()

    def device():
        def to(frame):
            name = tried / f"{frame['robot_id']}-{frame['n']}"
            assert not name.exists()
            name.touch()
            return -7 if 3 <= frame["n"] <= 5 else 0

        return to

    frames = q.queries()["st8_command_frames"](configured, SF).withColumn("timed_out", F.lit(0))
    stream = streamed(configured, frames, tmp_path, batches=3, by="n")

    def run():
        w = sinks.send(stream, device, str(tmp_path / "ledger"), str(tmp_path / "ck")).trigger(availableNow=True).start()
        w.awaitTermination()
        assert w.exception() is None

    run()
    ledger = configured.read.parquet(str(tmp_path / "ledger"))
    assert ledger.count() == frames.count() == len(list(tried.iterdir()))
    # the last micro-batch was sent and its ledger written, but the stream did not get to note it
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert configured.read.parquet(str(tmp_path / "ledger")).count() == frames.count()
    log = logs.send_log(configured.read.parquet(str(tmp_path / "ledger")), F.col("result"))
    got = sorted((r.robot_id, r.code, r.message) for r in log.collect())
    long = {r.robot_id: r["max(n)"] for r in frames.groupBy("robot_id").agg(F.max("n")).collect()}
    want = [(i, -7, "Error (-7) sending data to driver model. Make sure the driver model is running.") for i, n in long.items() if n >= 3]
    assert got == sorted(want + [(i, 0, "Data sent to driver model.") for i, n in long.items() if n >= 6])
    live = configured.readStream.schema(ledger.schema).parquet(str(tmp_path / "ledger")).withColumn("now", F.when(F.col("result") < 0, "fail").otherwise("ok"))
    edges = finish(processors.live(live.select("robot_id", "event_id", "ts", "now"), processors.StatusEdges()), "send_edges", tmp_path / "edges")
    assert edges.filter("edge = 'error'").count() == len(want)


def test_replies_follow_the_lifecycle(configured, tmp_path):
    e = streamed(configured, ev.events(configured, SF), tmp_path)
    got = finish(processors.live(processors.request_rows(ev.requests(e), ev.lifecycle(e)), processors.Replies()), "replies", tmp_path)
    want = q.queries()["val7_replies"](configured, SF)
    assert want.filter("is_running").count() and want.filter("NOT is_running AND successful").count()
    equal(got, want, ["robot_id", "event_id", "is_running", "successful", "reason"])


def test_shuffled_arrival_within_the_bound_gives_what_batch_gives(configured, tmp_path):
    """Rows come up to two days late: put in order they toggle as in batch. Later ones go to the side, counted."""
    pads = gamepad.decoded(ev.gamepad(ev.events(configured, SF))).select("robot_id", "event_id", "ts", "lb")
    end = pads.select("robot_id").distinct().select("robot_id", F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("lb"))
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86_400))
    rows = pads.unionByName(end).withColumn("arrival", F.when(F.col("event_id") < 0, F.lit(1e18)).otherwise(arrival))
    stream = streamed(configured, rows, tmp_path, batches=6, by="arrival").drop("arrival")
    read = published(processors.reordered(stream, 2 * 86_400_000), sinks.ordered_topics, tmp_path)
    assert read("late").count() == 0 and read("ordered").count() == pads.count()  # the last row of each robot still waits
    ordered = streamed(configured, read("ordered"), tmp_path / "again", batches=4, by="batch").drop("batch")
    got = finish(processors.live(ordered, processors.Toggle()), "reordered", tmp_path / "again")
    assert got.agg(F.max("late")).first()[0] == 0
    equal(got, q.queries()["joy3_toggle"](configured, SF), ["robot_id", "event_id", "armed"])


def in_batches(spark, batches, schema, tmp_path):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    return stream_topic(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)


def test_rows_beyond_the_bound_go_to_the_side(configured, tmp_path):
    t = [dt.datetime(2024, 1, 1, 0, 0, s) for s in range(20)]
    batches = [[(1, 1, t[1], None), (1, 5, t[5], 2.0)], [(1, 3, t[3], 1.0), (1, 9, t[9], 1.0), (2, 1, t[0], 1.0)], [(1, 2, t[2], 1.0), (1, 12, t[12], 1.0)]]
    stream = in_batches(configured, batches, "robot_id long, event_id long, ts timestamp_ntz, value double", tmp_path)
    read = published(processors.reordered(stream, 3000), sinks.ordered_topics, tmp_path)
    got = [(r.batch, r.event_id, r.value) for r in read("ordered").orderBy("batch", "ts").collect()]
    assert got == [(0, 1, None), (1, 3, 1.0), (1, 5, 2.0), (2, 9, 1.0)]  # 12 and the other robot's row still wait
    assert [(r.event_id, r.n_late) for r in read("late").collect()] == [(2, 1)]


def test_most_recent_at_each_trigger(configured, tmp_path):
    t = [dt.datetime(2024, 1, 1, h) for h in range(9)]
    batches = [[(1, 1, t[1]), (1, 3, t[3]), (1, 2, t[2]), (2, 1, t[1])], [(1, 2, t[2]), (1, 3, t[3])], [(1, 4, t[4]), (2, 2, t[1])]]
    stream = processors.most_recent(in_batches(configured, batches, "robot_id long, event_id long, ts timestamp_ntz", tmp_path))
    seen = []
    run = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted((r.robot_id, r.event_id, r.passed_over) for r in b.collect()))).outputMode("update")
    run = run.option("checkpointLocation", str(tmp_path / "ck")).start()  # states that expire keep a stream from ending by itself
    try:
        deadline = time.monotonic() + 90
        while sum(map(bool, seen)) < 2 and run.isActive and time.monotonic() < deadline:
            time.sleep(0.1)
    finally:
        run.stop()
    assert [x for x in seen if x] == [[(1, 3, 2), (2, 1, 0)], [(1, 4, 2), (2, 2, 0)]]


@pytest.mark.parametrize("seed", range(20))
def test_columns_step_as_rows_do(seed):
    """Whole columns, cut into micro-batches anywhere, give what single rows give."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    pixels = [list(map(int, rng.integers(0, 9, 3))) for _ in range(n)]
    df = pd.DataFrame({"event_id": range(n), "ts": pd.Timestamp(0), "lb": rng.integers(0, 2, n), "now": rng.choice(np.array(["ok", "bad", "worse", None], object), n),
                       "status": rng.choice(["ok", "no_frame", "data_error"], n), "pixels": [np.array(x) for x in pixels]})
    pressed, armed, was, shown, want = 0, False, "ok", None, ([], [], [])
    for i in range(n):
        lb, now, status = df["lb"][i], df["now"][i], df["status"][i]
        armed, pressed = armed ^ bool(lb and not pressed), lb
        want[0].append((i, armed))
        if now is not None and now != was:
            want[1].append((i, "recovered" if now == "ok" else "error"))
            was = now
        shown = pixels[i] if status == "ok" else shown
        if status != "data_error":
            want[2].append((i, shown, status == "no_frame"))
    cuts = sorted({0, n, *map(int, rng.integers(0, n + 1, 3))})
    for processor, rows in zip((processors.Toggle(), processors.StatusEdges(), processors.GapFill()), want, strict=True):
        state, got = list(processor.START), []
        for a, b in zip(cuts, cuts[1:]):
            got += processor.steps(state, df[a:b].reset_index(drop=True)).itertuples(index=False, name=None)
        assert [tuple(list(x) if isinstance(x, np.ndarray) else x for x in row) for row in got] == rows
