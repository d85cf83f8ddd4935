"""Sinks: CSV / JSON files and the tenant-bucketed stored-sales table (upsert, replace, delete)."""
