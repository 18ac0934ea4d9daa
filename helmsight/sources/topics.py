"""Topics as tables and streams with fixed schemas, and parameter logs seeded with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared parameters and their defaults; fixed values. Doubles, booleans and integers as strings.
DEFAULTS = {
    "driver": {"driver_uri": "tcpip://localhost:18888", "arm_robot": "true", "speed_limit_mode": "0", "body_speed_duration": "0.5", "hold": "false"},
    "camera": {
        "camera_num": "0", "frame_width_rgb": "848", "frame_height_rgb": "480", "frame_width_depth": "1280", "frame_height_depth": "720", "frame_rate": "30.0",
    },
}


def read_topic(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A recorded topic. The schema is never inferred."""
    return spark.read.schema(schema).parquet(path)


def stream_topic(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A live topic. files_per_trigger bounds a micro-batch, as queue depths bound what a node takes at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def declared_parameters(spark: SparkSession) -> DataFrame:
    """Rows (node, name, value) of all declared parameters."""
    rows = [(node, name, value) for node, names in DEFAULTS.items() for name, value in names.items()]
    return spark.createDataFrame(rows, "node string, name string, value string")


def command_topics(body: DataFrame, joint: DataFrame, led: DataFrame) -> DataFrame:
    """The three command topics as one in arrival order; `topic` says which, columns of other topics are null."""
    named = lambda df, topic: df.withColumn("topic", F.lit(topic))
    both = named(body, "cmd_vel").unionByName(named(joint, "joint_speed_cmd"), allowMissingColumns=True)
    return both.unionByName(named(led, "led_strip"), allowMissingColumns=True)
