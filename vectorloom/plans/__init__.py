"""Helpers that shape physical plans: shared staging tables and partition counts."""
