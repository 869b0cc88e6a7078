"""Operators on snapshots, as compositions of DataFrame operations."""
