"""Operators for large-scale training-data pipelines.

Each module holds one operator with its own general interface;
``catalogue`` applies them to the driver tables.
"""
