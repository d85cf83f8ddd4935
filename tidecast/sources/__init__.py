"""Sources: intake (CSV read, header resolution, row-wise validation, manifest, fallback), tenant (scans of
the stored multi-tenant table), testdata (sales-fact views over the driver's parquet tables)."""
