"""Readers of change logs and configuration, batch and streaming."""
