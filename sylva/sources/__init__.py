"""Reading tables and logs, and writing intermediate tables that survive lost executors."""
