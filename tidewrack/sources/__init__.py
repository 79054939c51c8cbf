"""Readers of landed payloads and stored tables."""
