"""Structured Streaming forms of what the editor and the dashboards do with timers and rings."""
