"""Training-data operators: language, scoring, duplicates, contamination, packing, archives and token files.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns a
DataFrame; :mod:`gridloom.llm.queries` registers one query for each.
"""
