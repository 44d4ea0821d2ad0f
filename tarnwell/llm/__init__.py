"""Operators for training-data work on chat, scanned and multilingual text.

Nothing outside this package imports it; it can be deleted and the rest still works.
"""
