"""Operators that prepare text and vectors for training runs.

Nothing else in the library imports this subpackage; deleting it leaves the
record-linkage engine whole.  ``registry`` holds the queries.
"""
