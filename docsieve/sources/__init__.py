"""Readers and writers for record files, label trees, tables and reports."""
