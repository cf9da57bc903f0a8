"""Structured Streaming versions of the record and run-event folds."""
