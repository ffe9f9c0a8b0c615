"""Operators that prepare training corpora: one module each, with its registered query and SQL."""
