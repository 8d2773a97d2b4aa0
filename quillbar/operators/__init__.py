"""Indicators, signals, labels, samples and metrics."""
