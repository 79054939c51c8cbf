"""Whole derivations composed from operators."""
