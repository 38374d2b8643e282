"""Training-data operators: sharding, filtering, de-duplication, mixing and packing.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries, one module holds each operator.
"""
