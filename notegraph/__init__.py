"""Versioned document collections on Spark."""
