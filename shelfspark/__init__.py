"""Analytics over catalogue-shaped tables, written as PySpark DataFrame jobs."""
