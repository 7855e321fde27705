"""End-to-end jobs (E1-E10) composed from operators."""
