"""Seasonal observation analytics and trip planning on Spark."""
