"""Operators on training text: packing, evaluation leakage, repetition."""
