"""Composed plans: the registry of checked queries (q_*.py, each with its DuckDB oracle), the flagship
report, and end-to-end workflows (EDA / chart bundles, upload flow, recommendations)."""
