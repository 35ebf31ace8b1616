"""Named queries over the star tables, each with its SQL twin."""
