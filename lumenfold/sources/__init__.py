"""Sources and sinks."""

from lumenfold.sources.tables import TABLES, table, tables

__all__ = ["TABLES", "table", "tables"]
