"""Sources and sinks: scan, column-role resolution, profiling, JSON/report sinks,
and the derivation of test inputs from the shared parquet tables."""
