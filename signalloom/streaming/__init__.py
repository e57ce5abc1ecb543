"""Streaming forms of the library's windows, runs, linking and sinks."""
