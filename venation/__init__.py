"""Organise, segment, measure and lay out collections of specimen photographs on Spark."""
