"""Streams: stable files by debounce, and intervals from logs as they come."""
