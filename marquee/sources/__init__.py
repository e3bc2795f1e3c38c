"""Readers of the booking tables, request tables and sinks."""
