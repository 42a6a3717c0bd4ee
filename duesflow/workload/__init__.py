"""The given benchmark tables seen as a ledger, and the registered queries over them."""
