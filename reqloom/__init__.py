"""Requirement analytics and corpus building on Spark."""
