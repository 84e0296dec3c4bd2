"""Operators for text corpora: token counts, packing, mixing, repetition."""
