"""Micro-batch telemetry and running counters."""
