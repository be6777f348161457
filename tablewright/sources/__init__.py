from tablewright.sources.tables import (
    scan, load_tables, sample, backup, overwrite, as_view, write_csv, write_json,
    read_csv, read_json, split_rescued, publish, recover, truncate, TABLE_NAMES,
)

__all__ = ["scan", "load_tables", "sample", "backup", "overwrite", "as_view", "write_csv",
           "write_json", "read_csv", "read_json", "split_rescued", "publish", "recover", "truncate", "TABLE_NAMES"]
