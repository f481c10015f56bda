"""Calibration analytics on Spark: contracts, metrics, groups, kernels, splits, text and telemetry."""
