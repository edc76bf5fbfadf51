"""Table schemas, loading, appends and the driver-table fixture mapping."""
