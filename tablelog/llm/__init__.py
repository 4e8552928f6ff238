"""Training-data operators: packing, deduplication, filtering, scans and archives.

Nothing outside this subpackage imports it.  ``catalog`` lists its queries.
"""
