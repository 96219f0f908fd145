"""Column builders: statistics, window features, smoothing, scores."""
