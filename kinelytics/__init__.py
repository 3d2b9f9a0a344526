"""Trajectory-quality analytics on Spark."""
