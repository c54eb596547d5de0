"""Live tailing of transcripts and of event tables through Structured Streaming."""

from lorekeep.streaming.tail import calls_with_results, heartbeats, once, replayed, stream_events, to_table, windows

__all__ = ["calls_with_results", "heartbeats", "once", "replayed", "stream_events", "to_table", "windows"]
