"""Operators for training text: packing, leakage of evaluation texts, splitting."""
