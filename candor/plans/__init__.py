"""Composed jobs, test-table adapters and the query catalogue."""
