"""The incremental guard over growing texts, and rate windows."""
