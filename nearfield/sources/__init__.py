"""Sources, ingestion and sinks."""
