"""DataFrame operators: voting, selection, metrics, token statistics, assembly."""
