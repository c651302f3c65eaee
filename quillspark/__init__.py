"""Document analytics on PySpark: retrieval, matching, versioning and publication operators."""
