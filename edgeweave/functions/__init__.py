"""Scalar functions and expressions."""
