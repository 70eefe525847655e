"""Operators from DataFrame to DataFrame, lazy and composable."""
