"""Multi-step plans and the queries that the driver runs."""
