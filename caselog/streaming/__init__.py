"""Monitoring of running cases on Structured Streaming."""
