"""Feature tables, query filters and edit sessions."""
