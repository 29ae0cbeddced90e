"""Column-level helpers (return pyspark Columns; all JVM-side)."""
