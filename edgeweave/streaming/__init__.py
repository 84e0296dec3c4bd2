"""Micro-batch maintenance of derived facts."""
