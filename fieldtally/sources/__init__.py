"""Readers for the raw tables, the daily payload unpivot, and sinks."""
