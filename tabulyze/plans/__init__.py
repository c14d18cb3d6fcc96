"""Registered queries: one Spark callable and, where SQL can say it, its oracle."""
