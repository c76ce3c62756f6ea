"""Lookups and building events over streams."""
