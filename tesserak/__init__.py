"""A retrieval and graph analytics library for PySpark."""
