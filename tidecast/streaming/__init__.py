"""Structured Streaming: upload-file ingest with foreachBatch upserts, watermarked daily totals."""
