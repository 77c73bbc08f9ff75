"""Readers and writers for long forms, responses, feature tables, models and predictions."""
