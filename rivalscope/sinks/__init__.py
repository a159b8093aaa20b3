"""Upserts, deletes and writers."""
