"""Continuous loading of landed batches with Structured Streaming."""
