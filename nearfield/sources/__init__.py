"""Storage of tables and indexes: Parquet snapshots and a pointer to the current one."""
