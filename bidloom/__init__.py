"""Procurement price analytics as Spark plans."""
