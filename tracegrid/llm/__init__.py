"""Training-data operators: quality, toxicity, near-duplicates, mixing, packing, search, archives.

Nothing outside this folder imports it; its queries are listed in ``tracegrid.llm.registry``.
"""
