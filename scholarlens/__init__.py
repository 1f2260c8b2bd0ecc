"""Literature-review and open-data-usage analytics as PySpark DataFrame jobs."""
