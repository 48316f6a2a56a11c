"""Operators that prepare training text at scale; each module is one operator."""
