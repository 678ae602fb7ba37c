"""Operators that prepare training texts at scale; nothing else in the library imports this package."""
