"""Writers: files, keyed table, catalog."""
