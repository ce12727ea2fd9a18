"""Operators for large training corpora: token files, near duplicates, packing, filters.

Each module holds one operator with a general interface; `queries` registers them with
production parameters over the given tables.  Nothing outside this folder imports it.
"""
