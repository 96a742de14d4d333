"""Report pipelines (``queries``) and their DuckDB oracle SQL (``oracle``)."""
