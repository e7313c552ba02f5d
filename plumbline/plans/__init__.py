"""Plans over the given tables, registered by name with the SQL they are checked with."""
