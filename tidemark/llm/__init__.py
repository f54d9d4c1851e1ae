"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.
"""
