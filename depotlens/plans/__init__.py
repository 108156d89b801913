"""Query plans: the registered queries (Spark) and their SQL oracles."""
