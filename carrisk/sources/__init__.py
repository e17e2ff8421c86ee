"""Sources and sinks: raw CSV, driver-table binding, Parquet checkpoints."""
