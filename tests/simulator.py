"""Sequential model of the driver and the gamepad node, written from their description, row by row."""

import math


def c_round(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


class DriverModel:
    def __init__(self):
        self.slots = {"user_led": 1.0, "r": 0.0, "g": 0.0, "b": 1.0, "s7": 0.0, "s8": 0.0}
        self.wheel, self.counter, self.stop = True, 0, 0
        self.p = {"arm_robot": True, "hold": False, "speed_limit_mode": 0, "body_speed_duration": 0.5}

    def body(self, x, z):
        self.slots.update(s7=x, s8=z)
        self.wheel, self.counter, self.stop = False, 0, c_round(self.p["body_speed_duration"] * 1000 / 16)

    def jog(self, names, velocities, duration):
        valid = False
        for i, name in enumerate(names):
            slot = {"left_wheel": "s7", "right_wheel": "s8"}.get(name)
            if slot:
                valid = True
                if i < len(velocities) and velocities[i] is not None:
                    self.slots[slot] = velocities[i]
        if valid:
            self.wheel, self.counter, self.stop = True, 0, c_round(duration * 1000 / 16)

    def led(self, r, g, b, a):
        self.slots.update(user_led=a, r=r, g=g, b=b)

    def tick(self):
        mode = (0 if self.wheel else 1) + (0 if self.p["speed_limit_mode"] == 0 else 2)
        if self.stop > 0:
            self.counter += 1
            if self.counter > self.stop:
                self.counter = 0
                self.slots.update(s7=0.0, s8=0.0)
        if not self.p["arm_robot"]:
            self.slots.update(s7=0.0, s8=0.0)
        return {"mode": float(mode), "enable": float(self.p["arm_robot"]), "hold": float(self.p["hold"]), **self.slots}


def toggles(presses):
    armed, before, out = False, 0, []
    for lb in presses:
        if lb and not before:
            armed = not armed
        before = lb
        out.append(armed)
    return out


def edges(statuses):
    was, out = "ok", []
    for i, s in enumerate(statuses):
        if s is not None and s != was:
            was = s
            out.append((i, "recovered" if s == "ok" else "error"))
    return out
