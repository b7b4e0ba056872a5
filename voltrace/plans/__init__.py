"""Named queries, SQL to hold them against, and the engine facade."""
