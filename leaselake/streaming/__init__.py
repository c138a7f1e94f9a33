"""Structured Streaming: lifecycle processors, jobs and sinks."""
