"""Faultlens: code, configuration, log and runtime-error diagnostics as Spark jobs."""

__version__ = "0.1.0"
