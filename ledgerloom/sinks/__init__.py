"""Writers: tables (overwrite, evolving append, upsert) and single-file exports."""
