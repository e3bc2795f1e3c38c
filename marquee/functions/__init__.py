"""Column-level helpers: exact rounding, text formats, labels, messages."""
