"""Training-data operators: tokenisers, language models, near-duplicate search, filters.

Nothing outside this package imports it.  Every operator takes a DataFrame and the names
of its id and text columns, reads only those columns (so further columns, clashing names
included, are harmless) and returns a DataFrame; the registered ``opN_`` queries are thin
wrappers in :mod:`textpipe.llm.queries`.
"""
