"""Named streams, consumer offsets and the change feed."""
