"""The registered queries: inputs derived from the given tables, the library's answers, and SQL for the same."""
