"""Named queries and the pipeline runner."""
