"""Streaming use of the column operators.

The reference has no streaming operator (no watermark, window or state).  What
carries over is that every Column-level mapping (SURVEY 2.4, 2.9, 2.10) and
every stream-static join (lookups, tiered lookups) works unchanged on a
Structured Streaming DataFrame.  ``write_stream`` appends the mapped rows to a
file table with exactly-once output.
"""

from tablewright.streaming.stream import read_table_stream, map_stream, write_stream

__all__ = ["read_table_stream", "map_stream", "write_stream"]
