"""Join orders: cost model, search, and execution."""
