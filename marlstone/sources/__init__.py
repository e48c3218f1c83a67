"""Readers and writers, and the shared folder in which a job keeps what it must read again."""

from marlstone.sources.shared import bucketed, clear, materialize, shared_path
from marlstone.sources.tables import read_files, table, write_files

__all__ = ["bucketed", "clear", "materialize", "read_files", "shared_path", "table", "write_files"]
