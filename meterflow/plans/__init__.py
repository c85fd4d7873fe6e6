"""Jobs, and the registered queries with their SQL."""
