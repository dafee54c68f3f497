"""SQL twins of the named queries, used only to check results."""
