"""Sources and sinks: the driver-table adapter, file and table I/O, table schemas."""
