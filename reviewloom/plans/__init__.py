"""Whole queries: work selection, scoring, write-back, summaries and reports."""
