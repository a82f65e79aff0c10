"""Index maintenance, telemetry and session state on Structured Streaming."""
