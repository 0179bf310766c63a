"""Trajectory, IMU and point-cloud analytics on Spark DataFrames."""
