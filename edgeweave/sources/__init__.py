"""Readers, writers and fact tables."""
