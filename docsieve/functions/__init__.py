"""Column-level text, label and document functions."""
