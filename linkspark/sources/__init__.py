"""Readers, writers and validators."""
