"""Input tables: driver parquet loaders and the derived governance views."""
