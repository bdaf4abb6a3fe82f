"""Identity upserts as micro-batches."""
