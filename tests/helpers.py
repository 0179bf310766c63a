"""Fixtures and brute-force twins in numpy."""

import numpy as np
import pandas as pd

from wayfold.functions.rigid import POSE_FIELDS

POSE = list(POSE_FIELDS)


def yaw_poses(drive, stamp, x, y, yaw, z=0.0):
    stamp = np.asarray(stamp, float)
    n = len(stamp)
    return pd.DataFrame(
        {
            "drive": drive, "idx": np.arange(n), "stamp": stamp, "x": np.broadcast_to(x, n).astype(float),
            "y": np.broadcast_to(y, n).astype(float), "z": np.broadcast_to(z, n).astype(float),
            "qw": np.cos(np.broadcast_to(yaw, n) / 2), "qx": 0.0, "qy": 0.0, "qz": np.sin(np.broadcast_to(yaw, n) / 2),
        }
    )


def circle(drive="a", n=400):
    p = np.linspace(0.0, 2 * np.pi, n)
    return yaw_poses(drive, np.arange(n) * 0.1, 50 * np.cos(p), 50 * np.sin(p), p + np.pi / 2)


def moved(poses, theta, tx, ty):
    out = poses.copy()
    c, s = np.cos(theta), np.sin(theta)
    out["x"], out["y"] = c * poses.x - s * poses.y + tx, s * poses.x + c * poses.y + ty
    yaw = 2 * np.arctan2(poses.qz, poses.qw) + theta
    out["qw"], out["qz"] = np.cos(yaw / 2), np.sin(yaw / 2)
    return out


def walk(drive, n, seed):
    """Random route with irregular stamps."""
    rng = np.random.default_rng(seed)
    stamp = np.cumsum(rng.uniform(0.05, 0.3, n))
    yaw = np.cumsum(rng.normal(0, 0.05, n))
    step = rng.uniform(0.0, 2.0, n)
    return yaw_poses(drive, stamp, np.cumsum(step * np.cos(yaw)), np.cumsum(step * np.sin(yaw)), yaw)
