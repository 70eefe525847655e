"""The query catalogue: each query with its oracle SQL."""
