"""Fixed values of the robot, as doubles computed the way the device code computes them."""

#: wheel radius in metres: a 3.5 inch wheel
WHEEL_RADIUS = 3.5 * 0.0254 / 2.0
#: distance between the wheels in metres
WHEEL_BASE = 0.3928
#: driver and joystick periods in milliseconds
TICK_MS, JOYSTICK_MS = 16, 100
DESIGN_CAPACITY = 7.0
BASE_FRAME, COLOR_FRAME, DEPTH_FRAME = "base_link", "color_image", "depth_image"
#: LED slots before any command, in slot order: user-LED flag, r, g, b
LED_START = {"user_led": 1.0, "r": 0.0, "g": 0.0, "b": 1.0}
#: gamepad gains
THROTTLE_GAIN, STEERING_GAIN = 0.8, 2.5
BIT_A, BIT_LB = 0, 4
LEFT_WHEEL, RIGHT_WHEEL = "left_wheel", "right_wheel"
SPEED_LIMIT_MODES = (0, 1)
BODY_DURATION_RANGE = (0.0, 600.0)
#: queue depths of telemetry and command topics, of image topics, and of the stream
TOPIC_DEPTH, IMAGE_DEPTH, STREAM_BUFFER = 10, 1, 1000
