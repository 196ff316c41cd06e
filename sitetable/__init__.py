"""Collected web pages as tables: parse, classify, redact, plan, label, export and sync on Spark."""

__version__ = "0.1.0"
