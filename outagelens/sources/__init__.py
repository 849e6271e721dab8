from outagelens.sources.tables import TABLES, read_table
from outagelens.sources import bindings

__all__ = ["TABLES", "read_table", "bindings"]
