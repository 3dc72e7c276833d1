"""Structured Streaming forms of the detectors and sinks."""
