"""Spark jobs for longitudinal panels, embedding tables and resampling statistics."""
