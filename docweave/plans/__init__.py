"""Named queries over the tables of a directory."""
