"""Work-item document analytics expressed as PySpark DataFrame jobs."""
