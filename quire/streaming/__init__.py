"""Structured Streaming operators over the progress-event feed."""
