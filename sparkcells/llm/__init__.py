"""Training-data operators: text scans, filters, deduplication, encoding and packing.

Nothing else in the library imports this subpackage.
"""
