"""Operators for large training corpora: sharding, language ID, media columns, packing, exact
and near deduplication, vector search, token files and byte-pair encoding.

Nothing outside this subpackage imports it. `queries` registers what the driver runs.
"""
