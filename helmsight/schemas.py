"""Schemas of frames and messages. Only what producers assign is specified."""

from pyspark.sql import types as T

_D = T.DoubleType()

#: telemetry slots in frame order
TELEMETRY_SLOTS = [
    "enc0", "enc1", "tach0", "tach1", "volt0", "volt1", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z",
    "cur0", "cur1", "battery_v", "watchdog", "device_ts",
]
#: command slots in frame order; s7 and s8 are wheel or body speeds as `mode` says
COMMAND_SLOTS = ["mode", "user_led", "r", "g", "b", "enable", "hold", "s7", "s8", "ts"]

_KEYS = [T.StructField("robot_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType())]

TELEMETRY = T.StructType([*_KEYS, T.StructField("status", T.StringType()), *(T.StructField(s, _D) for s in TELEMETRY_SLOTS)])
COMMAND = T.StructType([T.StructField("robot_id", T.LongType()), *(T.StructField(s, _D) for s in COMMAND_SLOTS)])
GAMEPAD = T.StructType([*_KEYS, *(T.StructField(c, _D) for c in ("x", "z", "rz")), T.StructField("buttons", T.IntegerType())])
BODY_COMMAND = T.StructType([*_KEYS, T.StructField("linear_x", _D), T.StructField("angular_z", _D)])
JOINT_COMMAND = T.StructType(
    [*_KEYS, T.StructField("joint_names", T.ArrayType(T.StringType())), T.StructField("velocities", T.ArrayType(_D)), T.StructField("duration", _D)]
)
LED_COMMAND = T.StructType([*_KEYS, *(T.StructField(c, _D) for c in "rgba")])
PARAMETER = T.StructType([*_KEYS, T.StructField("node", T.StringType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
#: `data` of colour images has height * width * 3 bytes; `pixels` of depth images are 16-bit values held as integers
IMAGE = T.StructType(
    [
        T.StructField("image_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField("data", T.BinaryType()), T.StructField("pixels", T.ArrayType(T.IntegerType())),
    ]
)
