"""Grouped pricing totals over a line-item table, as Spark DataFrame jobs."""
