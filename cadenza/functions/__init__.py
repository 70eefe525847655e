"""Column expressions; all stay inside Catalyst."""
