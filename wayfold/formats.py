"""Names of estimators and blame tags in tables and reports."""

from __future__ import annotations

# The two estimators of a recording. Recorded files are read by position, so their own column names do not matter.
ODOM = "odometry"
FILTER = "filter"

# Blame tags of an error section.
TAG_UNKNOWN = "unknown"
TAG_ODOM = f"{ODOM}_led"
TAG_FILTER = "ekf_diverged"
TAG_BOTH = "both"
TAG_NONE = "within_threshold"
