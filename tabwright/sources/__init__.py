"""Table readers, writers and ingest gates."""
