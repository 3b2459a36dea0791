"""Operators over the graph, the index and events, as DataFrame functions."""
