"""Column expressions and pure functions: paths, patterns, selectors, the SQL guard."""
