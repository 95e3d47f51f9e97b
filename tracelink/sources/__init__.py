"""Readers, sinks and published snapshots."""
