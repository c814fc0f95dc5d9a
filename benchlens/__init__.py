"""Modelling and explanation of benchmark results as Spark jobs."""
