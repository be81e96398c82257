"""Incremental building. The work has no unbounded streams: new keys are appended in batches."""
