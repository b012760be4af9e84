"""Structured Streaming: sources, event-time windows, late rows, sinks."""
