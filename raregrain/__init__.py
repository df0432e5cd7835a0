"""Rare-event analytics for Spark: features, splits, resampling, scoring, ensembles, metrics."""
