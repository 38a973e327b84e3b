"""Query plans: the registered ``q_*`` queries, their SQL oracles and tier choice."""
