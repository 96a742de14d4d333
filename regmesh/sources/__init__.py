"""Sources and sinks: parquet base tables, registry fixture views, CSV I/O."""
