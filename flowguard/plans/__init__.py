"""Named queries over the stored tables, each with its SQL counterpart."""
