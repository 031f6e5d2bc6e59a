"""Operators for preparing training data. Nothing else in this package imports this one."""
