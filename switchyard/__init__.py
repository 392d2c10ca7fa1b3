"""Spark-native analytics for card-payment routing: rates, forecasts, rule timelines, projections and rule generation."""
