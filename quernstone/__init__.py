"""Quernstone: corpus and experiment analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Queries built of them are
listed in :mod:`quernstone.plans`.  The subpackage ``llm`` is an addition that nothing else
imports.
"""
