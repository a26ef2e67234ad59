"""Readers, writers, fixed lookup tables and versioned publishing."""
