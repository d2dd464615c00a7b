"""Checkpointed append of scored records."""
