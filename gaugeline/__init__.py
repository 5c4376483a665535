"""Experiment and product analytics as Spark DataFrame operators."""
