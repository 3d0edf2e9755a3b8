"""Table-to-table operators for evidence-backed procurement analytics on Spark."""
