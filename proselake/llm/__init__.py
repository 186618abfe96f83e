"""Training-data operators: near-dedup, LM scoring, language ID, sharding, substring dedup,
media columns, sampled segmentation, packing, quality rules and secret scans."""
