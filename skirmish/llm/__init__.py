"""Training-data operators: thirteen corpus operators and their queries.

Nothing outside this subpackage imports it.
"""
