"""Sources and sinks: test tables, adapter views, tool-output readers, writers."""

from leaklens.sources.tables import Tables

__all__ = ["Tables"]
