"""End-to-end jobs, derived corpora and the query registry."""
