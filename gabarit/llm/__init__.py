"""Operators for training data: entity linkage, survivors, packing, leaks and personal details. Nothing outside imports this package."""
