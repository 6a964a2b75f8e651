"""Sources and sinks: raw log segments, encoded Parquet blocks, shared folders."""
