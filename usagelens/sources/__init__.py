"""Readers, declared schemas, writers and snapshots."""
