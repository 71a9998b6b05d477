"""Incremental linking in micro-batches."""
