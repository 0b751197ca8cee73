"""Named query plans (the registry) and their DuckDB oracle SQL."""
