"""Spark jobs that find, tokenise, redact, audit and restore private details in tables."""
