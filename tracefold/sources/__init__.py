"""Readers, writers and the derivation of reference-shaped tables."""
