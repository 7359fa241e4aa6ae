"""Readers, writers and canonical daily tables."""
