"""Named queries over the provided tables, with the SQL that checks them."""
