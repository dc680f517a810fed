"""Ladder analytics on Spark: leakage-free temporal features, rating models and metrics as DataFrame plans."""
