"""Streams into and out of a repository."""
