"""DataFrame operators: joins, aggregates, orderings, drift, metrics, profiles and models."""
