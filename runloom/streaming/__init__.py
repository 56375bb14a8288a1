"""Structured Streaming forms of the reports and operators."""
