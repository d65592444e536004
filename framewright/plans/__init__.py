"""Named queries over the Parquet tables, each with its SQL equivalent."""
