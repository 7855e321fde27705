"""Readers, fixture views and sinks."""

from coverlake.sources.tables import read_table, TABLES  # noqa: F401
