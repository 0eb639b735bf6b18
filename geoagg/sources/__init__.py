"""Sources and sinks: ingest of open maps, point tables, generators, saved datasets and their catalog."""
