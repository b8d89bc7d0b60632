"""Sources and sinks: raw readers, the test-table mapping, warehouse I/O."""

from vitrine.sources.raw import RawTables, read_raw, register_raw
from vitrine.sources.testdata import raw_from_testdata

__all__ = ["RawTables", "read_raw", "register_raw", "raw_from_testdata"]
