"""Streams of write requests into a log."""
