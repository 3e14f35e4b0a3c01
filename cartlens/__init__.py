"""Recommender analytics on Spark: cleaning, features, splits, models, ranking, metrics, A/B and monitoring."""
