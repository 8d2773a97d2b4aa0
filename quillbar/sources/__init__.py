"""Scans, resampling and sinks."""
