"""Telemetry derived from the `events` table, and the SQL the results are checked against."""
