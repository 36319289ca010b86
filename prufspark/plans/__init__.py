"""Plan-level helpers: lineage cuts, bounded broadcasts, hot-key salting."""
