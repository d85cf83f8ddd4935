"""Training-data operators: tokenisation, scans, scoring, deduplication, mixing, search and packing.

Nothing outside this package imports it; ``queries.py`` holds the checked queries.
"""
