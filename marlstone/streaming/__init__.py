"""Structured Streaming plans over the events table."""

from marlstone.streaming.pairs import drained, followed
from marlstone.streaming.stateful import since_last
from marlstone.streaming.windows import event_stream, sessions, windowed

__all__ = ["drained", "event_stream", "followed", "sessions", "since_last", "windowed"]
