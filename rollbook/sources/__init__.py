"""Readers and writers of register snapshots."""
