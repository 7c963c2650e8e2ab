"""Training-data operators (mixing, scans, formatting, dedup, scoring).

Nothing outside this package imports it; ``queries`` registers its queries.
"""
