"""Live trace ingest with Structured Streaming."""
