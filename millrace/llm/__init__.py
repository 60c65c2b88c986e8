"""Operators for large training-text collections: language, overlap, encoding repair, copies, near-copies, splitting, packing, mixing, subjects."""
