"""Vectorised prefix products for one chunk of ordered rows (numpy inside Spark tasks)."""

from __future__ import annotations

import numpy as np


def quat_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    aw, ax, ay, az = np.moveaxis(a, -1, 0)
    bw, bx, by, bz = np.moveaxis(b, -1, 0)
    return np.stack(
        [
            aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
            aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw,
        ],
        axis=-1,
    )


def quat_rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    t = 2.0 * np.cross(q[..., 1:], v)
    return v + q[..., :1] * t + np.cross(q[..., 1:], t)


def quat_exp(w: np.ndarray) -> np.ndarray:
    theta = np.linalg.norm(w, axis=-1, keepdims=True)
    k = np.where(theta < 1e-8, 0.5, np.sin(theta / 2) / np.where(theta < 1e-8, 1.0, theta))
    return np.concatenate([np.cos(theta / 2), w * k], axis=-1)


def pose_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Poses as rows (x, y, z, qw, qx, qy, qz)."""
    return np.concatenate(
        [quat_rotate(a[..., 3:], b[..., :3]) + a[..., :3], quat_mul(a[..., 3:], b[..., 3:])], axis=-1
    )


def se3_exp(xi: np.ndarray) -> np.ndarray:
    """Rows (v, w) to pose rows (x, y, z, qw, qx, qy, qz)."""
    v, w = xi[:, :3], xi[:, 3:]
    t2 = np.sum(w * w, axis=1, keepdims=True)
    t = np.sqrt(t2)
    small = t < 1e-3
    safe = np.where(small, 1.0, t)
    b = np.where(small, 0.5 - t2 / 24.0, (1.0 - np.cos(safe)) / safe**2)
    c = np.where(small, 1.0 / 6.0 - t2 / 120.0, (safe - np.sin(safe)) / safe**3)
    wv = np.cross(w, v)
    return np.concatenate([v + b * wv + c * np.cross(w, wv), quat_exp(w)], axis=1)


def clamp_add(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Composition of s -> min(max(s + d, lo), hi), rows (d, lo, hi); closed under composition."""
    d = first[..., 0] + then[..., 0]
    lo = np.clip(first[..., 1] + then[..., 0], then[..., 1], then[..., 2])
    hi = np.clip(first[..., 2] + then[..., 0], then[..., 1], then[..., 2])
    return np.stack([d, lo, hi], axis=-1)


def prefix(rows: np.ndarray, combine) -> np.ndarray:
    """Inclusive prefix of an associative `combine`, in log2(n) vectorised passes."""
    out = np.array(rows, dtype=float, copy=True)
    shift = 1
    while shift < len(out):
        out[shift:] = combine(out[:-shift], out[shift:])
        shift *= 2
    return out
