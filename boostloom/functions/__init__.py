"""Aggregates, losses, objectives and projections over rows with a distribution."""
