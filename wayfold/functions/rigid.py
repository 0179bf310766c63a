"""Rigid-body algebra as Column expressions: quaternions (w, x, y, z), vectors, SE(2), SE(3).

Everything stays inside whole-stage codegen. A pose is a struct
`<x, y, z, qw, qx, qy, qz>`; long chains are split over `withColumn` steps by the callers so that expression
trees stay small.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import let

POSE_FIELDS = ("x", "y", "z", "qw", "qx", "qy", "qz")
SMALL = 1.0e-8


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def __add__(self, other):  # type: ignore[override]
        return Vec(self.x + other.x, self.y + other.y, self.z + other.z)

    def __sub__(self, other):
        return Vec(self.x - other.x, self.y - other.y, self.z - other.z)

    def scale(self, k) -> "Vec":
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, other) -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z

    def cross(self, other) -> "Vec":
        return Vec(
            self.y * other.z - self.z * other.y,
            self.z * other.x - self.x * other.z,
            self.x * other.y - self.y * other.x,
        )

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))


class Quat(NamedTuple):
    w: Column
    x: Column
    y: Column
    z: Column

    @property
    def vec(self) -> Vec:
        return Vec(self.x, self.y, self.z)

    def conj(self) -> "Quat":
        return Quat(self.w, -self.x, -self.y, -self.z)

    def mul(self, o: "Quat") -> "Quat":
        return Quat(
            self.w * o.w - self.x * o.x - self.y * o.y - self.z * o.z,
            self.w * o.x + self.x * o.w + self.y * o.z - self.z * o.y,
            self.w * o.y - self.x * o.z + self.y * o.w + self.z * o.x,
            self.w * o.z + self.x * o.y - self.y * o.x + self.z * o.w,
        )

    def rotate(self, v: Vec) -> Vec:
        """v + 2 w (u x v) + 2 u x (u x v)."""
        t = self.vec.cross(v).scale(F.lit(2.0))
        return v + t.scale(self.w) + self.vec.cross(t)


class Pose(NamedTuple):
    t: Vec
    q: Quat

    def struct(self) -> Column:
        return F.struct(
            *[c.cast("double").alias(n) for c, n in zip((*self.t, *self.q), POSE_FIELDS, strict=True)]
        )

    def inverse(self) -> "Pose":
        back = self.q.conj()
        return Pose(back.rotate(self.t).scale(F.lit(-1.0)), back)

    def mul(self, o: "Pose") -> "Pose":
        return Pose(self.q.rotate(o.t) + self.t, self.q.mul(o.q))

    def between(self, o: "Pose") -> "Pose":
        """inverse(self) * o."""
        back = self.q.conj()
        return Pose(back.rotate(o.t - self.t), back.mul(o.q))

    def apply(self, v: Vec) -> Vec:
        return self.q.rotate(v) + self.t


def vec(prefix: str = "", names: tuple[str, str, str] = ("x", "y", "z")) -> Vec:
    return Vec(*[F.col(prefix + n) for n in names])


def pose(prefix: str = "") -> Pose:
    """Pose read from columns `<prefix>x ... <prefix>qz`; a struct column is read with prefix `name.`."""
    return Pose(vec(prefix), Quat(*[F.col(prefix + n) for n in ("qw", "qx", "qy", "qz")]))


def lit_vec(x: float, y: float, z: float) -> Vec:
    return Vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def identity_struct() -> Column:
    return Pose(lit_vec(0, 0, 0), Quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).struct()


def wrap_angle(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + F.pi(), F.lit(2.0) * F.pi()) - F.pi()


def clamp(value: Column, low, high) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(value, as_col(low)), as_col(high))


def unit_quat(q: Quat) -> Quat:
    """Normalise; a zero-norm quaternion becomes the identity."""
    n = F.sqrt(q.w * q.w + q.x * q.x + q.y * q.y + q.z * q.z)
    ok = n >= 1.0e-9
    return Quat(
        F.when(ok, q.w / n).otherwise(1.0), F.when(ok, q.x / n).otherwise(0.0),
        F.when(ok, q.y / n).otherwise(0.0), F.when(ok, q.z / n).otherwise(0.0),
    )


def quat_from_rpy(roll: Column, pitch: Column, yaw: Column) -> Quat:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    half = F.lit(0.5)
    cr, sr = F.cos(roll * half), F.sin(roll * half)
    cp, sp = F.cos(pitch * half), F.sin(pitch * half)
    cy, sy = F.cos(yaw * half), F.sin(yaw * half)
    return Quat(
        cy * cp * cr + sy * sp * sr, cy * cp * sr - sy * sp * cr,
        cy * sp * cr + sy * cp * sr, sy * cp * cr - cy * sp * sr,
    )


def yaw_quat(yaw: Column) -> Quat:
    return Quat(F.cos(yaw * 0.5), F.lit(0.0), F.lit(0.0), F.sin(yaw * 0.5))


def frd_attitude(heading: Column, pitch: Column, roll: Column) -> Quat:
    """Attitude of the recorded ground truth: R_roll R_pitch R_yaw with transposed elementary rotations."""
    q_roll = Quat(F.cos(roll * 0.5), -F.sin(roll * 0.5), F.lit(0.0), F.lit(0.0))
    q_pitch = Quat(F.cos(pitch * 0.5), F.lit(0.0), -F.sin(pitch * 0.5), F.lit(0.0))
    q_yaw = Quat(F.cos(heading * 0.5), F.lit(0.0), F.lit(0.0), -F.sin(heading * 0.5))
    return q_roll.mul(q_pitch).mul(q_yaw)


def yaw_of(q: Quat) -> Column:
    return F.atan2(
        F.lit(2.0) * (q.w * q.z + q.x * q.y), F.lit(1.0) - F.lit(2.0) * (q.y * q.y + q.z * q.z)
    )


def rpy_of(q: Quat) -> tuple[Column, Column, Column]:
    two, one = F.lit(2.0), F.lit(1.0)
    r00 = one - two * (q.y * q.y + q.z * q.z)
    r10 = two * (q.x * q.y + q.w * q.z)
    r20 = two * (q.x * q.z - q.w * q.y)
    r21 = two * (q.y * q.z + q.w * q.x)
    r22 = one - two * (q.x * q.x + q.y * q.y)
    return F.atan2(r21, r22), F.atan2(-r20, F.hypot(r00, r10)), F.atan2(r10, r00)


def limit_forward(predicted: Pose, found: Pose, most: float) -> Pose:
    """`found` with its correction along the vehicle (body x of `predicted`) held within `most` metres.

    A negative or non-finite limit means none. The correction's other parts stay.
    """
    if not 0.0 <= most < float("inf"):
        return found
    step = predicted.between(found)
    held = F.greatest(F.least(step.t.x, F.lit(float(most))), F.lit(-float(most)))
    return predicted.mul(Pose(Vec(held, step.t.y, step.t.z), step.q))


def reframe(p: Pose, transform: Pose) -> Pose:
    """A pose of a local frame in the frame that `transform` leads to (map from local)."""
    return transform.mul(p)


def rotation_angle(q: Quat) -> Column:
    """In [0, pi]; stays accurate near zero."""
    return F.lit(2.0) * F.atan2(q.vec.norm(), F.abs(q.w))


def so3_exp(w: Vec) -> Quat:
    theta = w.norm()
    half = theta * 0.5
    k = F.when(theta < SMALL, F.lit(0.5)).otherwise(F.sin(half) / theta)
    return Quat(F.cos(half), w.x * k, w.y * k, w.z * k)


class Twist(NamedTuple):
    """Tangent of SE(3): translation part, rotation part."""

    v: Vec
    w: Vec

    def scale(self, k) -> "Twist":
        return Twist(self.v.scale(k), self.w.scale(k))

    def struct(self) -> Column:
        return F.struct(
            *[c.cast("double").alias(n) for c, n in zip((*self.v, *self.w), TWIST_FIELDS, strict=True)]
        )


TWIST_FIELDS = ("vx", "vy", "vz", "wx", "wy", "wz")


def twist(prefix: str = "") -> Twist:
    return Twist(vec(prefix, ("vx", "vy", "vz")), vec(prefix, ("wx", "wy", "wz")))


# --- staged forms --------------------------------------------------------------------------------------
# exp, log and slerp use their intermediate results many times. As single expressions they would be expanded
# over and over, so these forms put every intermediate into a column first. Inputs have to be plain columns.


QNAMES = ("qw", "qx", "qy", "qz")


def _named(prefix: str, names, values) -> dict[str, Column]:
    return {prefix + n: c for n, c in zip(names, values, strict=True)}


def _quat(prefix: str) -> Quat:
    return Quat(*[F.col(prefix + n) for n in QNAMES])


def _so3_log_steps(q: Quat, p: str) -> dict[str, Column]:
    n, k = F.col(p + "n"), F.col(p + "k")
    angle = F.lit(2.0) * F.atan2(n, F.abs(q.w))
    sign = F.when(q.w < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    steps = {p + "n": q.vec.norm(), p + "k": F.when(n < SMALL, F.lit(2.0)).otherwise(angle / n) * sign}
    return steps | _named(p, ("wx", "wy", "wz"), q.vec.scale(k))


def _so3_exp_steps(w: Vec, p: str) -> dict[str, Column]:
    t, k = F.col(p + "th"), F.col(p + "sk")
    half = t * 0.5
    steps = {p + "th": w.norm(), p + "sk": F.when(t < SMALL, F.lit(0.5)).otherwise(F.sin(half) / t)}
    return steps | _named(p, QNAMES, (F.cos(half), w.x * k, w.y * k, w.z * k))


def _se3_exp_steps(xi: Twist, p: str, into: str) -> dict[str, Column]:
    t2, t, u = F.col(p + "t2"), F.col(p + "t"), vec(p + "u")
    small = t < 1.0e-3
    steps = {
        p + "t2": xi.w.dot(xi.w), p + "t": F.sqrt(t2),
        p + "b": F.when(small, F.lit(0.5) - t2 / 24.0).otherwise((F.lit(1.0) - F.cos(t)) / t2),
        p + "c": F.when(small, F.lit(1.0 / 6.0) - t2 / 120.0).otherwise((t - F.sin(t)) / (t2 * t)),
        **_named(p + "u", ("x", "y", "z"), xi.w.cross(xi.v)), **_so3_exp_steps(xi.w, p),
    }
    move = xi.v + u.scale(F.col(p + "b")) + xi.w.cross(u).scale(F.col(p + "c"))
    return steps | {into: Pose(move, _quat(p)).struct()}


def _se3_log_steps(pose_: Pose, p: str, into: str) -> dict[str, Column]:
    w, t2, h, u = vec(p, ("wx", "wy", "wz")), F.col(p + "t2"), F.col(p + "h"), vec(p + "u")
    k = F.when(h < 0.5e-3, F.lit(1.0 / 12.0) + t2 / 720.0).otherwise((F.lit(1.0) - h * F.cos(h) / F.sin(h)) / t2)
    steps = {
        **_so3_log_steps(pose_.q, p), p + "t2": w.dot(w), p + "h": F.sqrt(t2) * 0.5, p + "kk": k,
        **_named(p + "u", ("x", "y", "z"), w.cross(pose_.t)),
    }
    v = pose_.t - u.scale(F.lit(0.5)) + w.cross(u).scale(F.col(p + "kk"))
    return steps | {into: Twist(v, w).struct()}


def stage_se3_exp(df: DataFrame, xi: Twist, into: str) -> DataFrame:
    """Pose struct `into` of the tangent `xi`."""
    steps = _se3_exp_steps(xi, f"_{into}_", into)
    return let(df, steps, [n for n in steps if n != into])


def stage_se3_log(df: DataFrame, p: Pose, into: str) -> DataFrame:
    """Tangent struct `into` of the pose `p`."""
    steps = _se3_log_steps(p, f"_{into}_", into)
    return let(df, steps, [n for n in steps if n != into])


def stage_clamp(df: DataFrame, value: Pose, prior: Pose, translation: float, rotation: float, into: str) -> DataFrame:
    """Pose struct `into`: `value`, with both parts of its tangent seen from `prior` shortened to the given lengths."""
    p = f"_{into}_"
    xi = twist(p + "x.")

    def held(part: Vec, most: float) -> Vec:
        n = part.norm()
        return part.scale(F.when((n > most) & (n > 1.0e-12), F.lit(float(most)) / n).otherwise(1.0))

    steps = {
        p + "m": prior.between(value).struct(), **_se3_log_steps(pose(p + "m."), p + "l", p + "x"),
        p + "y": Twist(held(xi.v, translation), held(xi.w, rotation)).struct(),
        **_se3_exp_steps(twist(p + "y."), p + "g", p + "e"), into: prior.mul(pose(p + "e.")).struct(),
    }
    return let(df, steps, [n for n in steps if n != into])


def stage_slerp(df: DataFrame, q0: Quat, q1: Quat, alpha: Column, into: str) -> DataFrame:
    """Quaternion columns `<into>qw ... <into>qz` at fraction `alpha` of the turn from q0 to q1."""
    p = f"_{into}_"
    steps = {
        **_named(p + "r", QNAMES, q0.conj().mul(q1)), **_so3_log_steps(_quat(p + "r"), p),
        **_named(p + "s", ("x", "y", "z"), [F.col(p + n) * alpha for n in ("wx", "wy", "wz")]),
        **_so3_exp_steps(vec(p + "s"), p + "e"), **_named(into, QNAMES, q0.mul(_quat(p + "e"))),
    }
    return let(df, steps, [n for n in steps if n.startswith(p)])


def stage_screw(df: DataFrame, a: Pose, b: Pose, alpha: Column, into: str) -> DataFrame:
    """Pose struct `into` = a exp(alpha log(a^-1 b))."""
    p = f"_{into}_"
    steps = {
        p + "m": a.between(b).struct(), **_se3_log_steps(pose(p + "m."), p + "l", p + "x"),
        p + "y": twist(p + "x.").scale(alpha).struct(), **_se3_exp_steps(twist(p + "y."), p + "g", p + "e"),
        into: a.mul(pose(p + "e.")).struct(),
    }
    return let(df, steps, [n for n in steps if n != into])
