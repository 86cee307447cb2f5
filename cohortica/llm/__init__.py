"""Operators that prepare text corpora for training.

Nothing outside this folder imports it.  ``queries`` holds the registered
queries, every other module one operator.
"""
