"""Training-data operators: language ID, deduplication, filtering, mixing and output.

Nothing outside this subpackage imports it.
"""
