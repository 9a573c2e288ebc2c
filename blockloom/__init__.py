"""PySpark engine for content-addressed datasets."""
