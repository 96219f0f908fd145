"""Sources and sinks: tables, files, registries, schemas."""
