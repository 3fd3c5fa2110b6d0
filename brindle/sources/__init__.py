"""Reading tables and artifacts, and tenant scopes."""
