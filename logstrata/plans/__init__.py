"""Physical layout as tables, and decisions made from it."""
