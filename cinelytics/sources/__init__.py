"""Sources and sinks: ``::`` text files, keyed Parquet tables, JDBC."""
