"""Bulk quoting and cost analytics as Spark DataFrame jobs."""
