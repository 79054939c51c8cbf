"""Structured Streaming: live positions to one row per vessel and hour."""
