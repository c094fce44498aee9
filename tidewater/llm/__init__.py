"""Training-data operators: scans, packing, sharding, dedup, scoring and extraction at corpus scale.

Nothing else in the library imports this subpackage.
"""
