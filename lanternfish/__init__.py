"""A PySpark engine for retrieval and conversation analytics."""
