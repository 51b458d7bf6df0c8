"""Reading and writing logs, metrics and vocabularies."""
