"""Readers of mixed document sources, with counters of what was dropped; the shard writer and its manifest."""
