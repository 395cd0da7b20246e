"""Jobs composed of operators: ingest, metrics, reports."""
