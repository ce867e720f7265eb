"""Reading and writing: CSV folders, the ledger table, manifests and result files."""
