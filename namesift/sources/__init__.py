from namesift.sources.tables import read_table, write_table

__all__ = ["read_table", "write_table"]
