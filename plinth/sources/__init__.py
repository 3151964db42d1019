"""Sources and sinks: delimited records, the clustered store, result files."""
