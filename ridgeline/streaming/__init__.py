"""Fits over streams. Beyond batch fits: statistics of a Gaussian fit are sums, so micro-batches add to them."""
