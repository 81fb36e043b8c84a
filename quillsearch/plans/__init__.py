"""Named queries, their SQL oracles and the user-facing engine."""
