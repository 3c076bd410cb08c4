"""Views over source tables, and the registered queries with their SQL."""
