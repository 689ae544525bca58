"""DuckDB statements that compute what the registered queries compute."""
