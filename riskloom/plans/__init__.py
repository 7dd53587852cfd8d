"""Named queries over the supplied tables and the SQL each one is checked against."""
