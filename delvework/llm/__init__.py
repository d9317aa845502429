"""Operators that turn an indexed source tree and its documents into training text."""
