"""Point-in-time tables on Spark: lake scans, audits, snapshots, as-of views, text search and performance statistics."""
