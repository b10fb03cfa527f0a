"""Named queries and workflows."""
