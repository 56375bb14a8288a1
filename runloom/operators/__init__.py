"""Operators over tables of logs, metrics, runs and application statuses."""
