"""Training-data operators: chat linking, quality, dedup, toxicity, mixing, packing, licences, fingerprints, vector search.

Nothing outside this subpackage imports it.
"""
