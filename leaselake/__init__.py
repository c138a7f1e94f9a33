"""A lease-finance warehouse on PySpark: change logs, dimensions, facts, summaries."""
