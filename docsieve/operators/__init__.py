"""Relational, feature, sampling, model and evaluation operators."""
