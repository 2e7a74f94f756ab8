"""Registered queries and the fixture they run on."""
