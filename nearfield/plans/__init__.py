"""Index plans: the proximity graph kernel, the persisted index, and the registered queries."""
