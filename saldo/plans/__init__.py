"""Ready plans: the ledger view over the star tables, and the registered queries."""
