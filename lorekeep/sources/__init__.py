"""Reading session transcripts."""

from lorekeep.sources.sessions import changed_since, events, listed, newest_of, read_lines, read_sessions

__all__ = ["changed_since", "events", "listed", "newest_of", "read_lines", "read_sessions"]
