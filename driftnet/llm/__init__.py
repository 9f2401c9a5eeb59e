"""Operators for preparing training text and vectors. Nothing else in the package imports this one."""
