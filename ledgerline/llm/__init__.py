"""Operators that prepare training text: deduplication, classifiers, mixing, chat formatting, packing, search."""
