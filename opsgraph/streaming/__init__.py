"""Structured Streaming: documents and notes into the graph, alerts out of it."""
