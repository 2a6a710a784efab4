"""Repeated-measurement analytics on Spark: series, retrieval, evaluation and care-record operators as DataFrame plans."""
