"""DataFrame operators: predicates, entity filters, traces, rollups, reports, retention."""
