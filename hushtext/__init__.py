"""Differentially private text sanitization by retrieval, and its evaluation, on Spark."""
