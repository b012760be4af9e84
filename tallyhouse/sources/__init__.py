"""Batch readers and the projection of relational tables onto EVENT."""
